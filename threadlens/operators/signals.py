"""Signals of sessions: what was asked, whether it worked, and what risks a transcript carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions import text as T


def signal_messages(messages: DataFrame, keys: list[str], told: dict[str, Column] | None = None) -> DataFrame:
    """User and assistant messages with text, in order, with the role before each; `told` are columns of what their `role` and `text` tell.

    With `told`, the texts themselves are left behind, so what is shuffled to bring a session together are these columns only.
    """
    m = messages.withColumn("role", F.lower(F.trim("role"))).withColumn("text", T.trim_white(F.col("text")))
    m = m.where((F.col("text") != "") & F.col("role").isin("user", "assistant") & ~T.is_noise(F.col("text")))
    if told is not None:
        m = m.select(*keys, "ts", "id", "role", *[c.alias(name) for name, c in told.items()])
    order = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0.0)), "id")
    return m.withColumn("before", F.lag("role").over(order))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def signal_counts(messages: DataFrame, keys: list[str]) -> DataFrame:
    text = F.col("text")
    correction, passed, failed = T.matches(text, R.CORRECTION), T.matches(text, R.TEST_PASSED), T.matches(text, R.TEST_FAILED)
    low = F.lower(text)
    code = low.contains("```") | low.contains("func ") | low.contains("class ") | low.contains("implement") | low.contains("实现") | low.contains("代码")
    flags = {
        "corrections": correction,
        "acceptances": ~correction & T.matches(text, R.ACCEPTANCE),
        "decisions": T.matches(text, R.DECISION),
        "questions": T.matches(text, R.QUESTION),
        "workflows": T.matches(text, R.WORKFLOW),
        "implementations": code,
        "passes": passed & ~failed,
        "failures": failed,
        "one_offs": T.matches(text, R.ONE_OFF),
    }
    told = {"secrets": T.secret_count(text), **{n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}}
    # Only an answer corrects or accepts.
    answered = F.coalesce((F.col("before") == "assistant") & (F.col("role") == "user"), F.lit(False))
    counted = signal_messages(messages, keys, told).withColumns({n: F.col(n) & answered for n in ("corrections", "acceptances")})
    return counted.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("secrets").alias("secrets"), *[F.count_if(F.col(n)).alias(n) for n in flags])


def signal_bundle(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Intent, confidence, evidence, risks and the recommended action of each session with messages."""
    s = signal_counts(messages, keys)
    c = F.col
    intent = (
        F.when((c("corrections") > 0) & (c("corrections") >= c("acceptances")), "correction")
        .when((c("acceptances") > c("corrections")) & (c("passes") > 0), "acceptance")
        .when(c("decisions") > 0, "decision").when(c("workflows") > 0, "workflow").when(c("implementations") > 0, "implementation")
        .when(c("questions") > 0, "question").when(c("acceptances") > 0, "acceptance").when(c("failures") > 0, "correction").otherwise("unknown")
    )
    s = s.withColumn("intent", intent).withColumn("secret_risk", _clamp(c("secrets") * 0.75))
    s = s.withColumn("positive", c("acceptances") * 1.0 + c("passes") * 0.9).withColumn("negative", c("corrections") * 1.25 + c("failures") * 1.0)
    confidence = F.lit(0.34) + F.least(F.lit(0.42), (c("positive") + c("negative")) * 0.08) + F.when(c("intent") != "unknown", 0.08).otherwise(0.0) + F.when(c("n") >= 3, 0.06).otherwise(0.0) + F.least(F.lit(0.1), c("secret_risk") * 0.1)
    risk = F.lit(0.58) + F.when(c("n") <= 2, 0.2).otherwise(0.0) - F.when(c("workflows") > 0, 0.35).otherwise(0.0) - F.when(c("acceptances") > 0, 0.12).otherwise(0.0) - F.when(c("corrections") > 0, 0.04).otherwise(0.0) - F.when(c("passes") > 0, 0.08).otherwise(0.0)
    s = s.withColumn("confidence", _clamp(confidence)).withColumn("one_off_risk", F.when(c("one_offs") > 0, 0.95).otherwise(_clamp(risk)))
    action = (
        F.when((c("secret_risk") >= 0.75) | (c("one_off_risk") >= 0.92), "suppress")
        .when((c("negative") > c("positive") + 0.35) | (c("failures") > c("passes")) | (c("intent") == "correction") | (c("confidence") < 0.45), "review")
        .when((c("positive") > 0) | (c("passes") > 0) | c("intent").isin("workflow", "decision"), "draft").otherwise("review")
    )
    evidence = F.concat_ws("|", F.when(c("acceptances") > 0, "acceptance"), F.when(c("passes") > 0, "tests_passed"))
    return s.select(*keys, "intent", F.round("confidence", 6).alias("confidence"), evidence.alias("success_evidence"), F.round("one_off_risk", 6).alias("one_off_risk"), "secret_risk", action.alias("action"))


def quality_gate(bundles: DataFrame) -> DataFrame:
    """Whether a session is drafted or suppressed, its score and the reasons."""
    n = F.size(F.filter(F.split("success_evidence", "\\|"), lambda e: e != ""))
    reasons = F.concat_ws("|", F.when(n < 1, "insufficient success evidence"), F.when(F.col("one_off_risk") >= 0.8, "one-off risk is high"), F.when(F.col("secret_risk") >= 0.75, "secret risk is high"))
    score = F.least(F.lit(1.0), F.col("confidence") + F.when(n > 1, F.least(F.lit(0.15), (n - 1) * 0.05)).otherwise(0.0))
    out = bundles.withColumn("reasons", reasons)
    return out.withColumn("disposition", F.when(F.col("reasons") == "", "draft").otherwise("suppress")).withColumn("score", F.round(F.when(F.col("reasons") == "", score).otherwise(0.0), 6))
