"""Sessions from messages: roll-up, statistics, listings and last rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timestamps import format_timestamp
from ..plans.tables import TOOLS

LAST_ROUND_CHARS = 2000
PHYSICAL = ["tool", "session_id", "source_path"]
LOGICAL = ["tool", "session_id"]


def session_rollup(messages: DataFrame) -> DataFrame:
    """One row per physical session. Everything is a minimum or maximum, so it is combined before the shuffle."""
    title = F.when(F.col("role") == "user", T.title_from_text(F.col("text")))
    m = messages.withColumn("title", F.when(title != "", title)).withColumn("some_cwd", F.when(F.col("cwd") != "", F.col("cwd")))
    return m.groupBy(*PHYSICAL).agg(
        F.min("ts").alias("created"),
        F.max("ts").alias("updated"),
        F.coalesce(F.min(F.when(F.col("some_cwd").isNotNull(), F.struct("id", "some_cwd")))["some_cwd"], F.lit("")).alias("cwd"),
        F.coalesce(F.min(F.when(F.col("title").isNotNull(), F.struct("id", "title")))["title"], F.lit("")).alias("title"),
        F.count("*").alias("n_messages"),
    )


def tool_stats(messages: DataFrame) -> DataFrame:
    """Sessions and messages of every tool, zero where there are none."""
    tools = messages.sparkSession.createDataFrame([(t,) for t in TOOLS], "tool string")
    per_session = messages.groupBy(*LOGICAL).agg(F.count("id").alias("n"))
    counted = per_session.groupBy("tool").agg(F.count("*").alias("sessions"), F.sum("n").alias("messages"))
    return tools.join(counted, "tool", "left").na.fill(0)


def has_prefix(prefix: str) -> Column:
    """Whether a session's id starts with `prefix`, whatever the case of ASCII letters."""
    return T.ascii_lower(F.col("session_id")).startswith(T.ascii_lower_of(prefix))


def show(messages: DataFrame, prefix: str, *, role: str | None = None, limit: int = 0) -> DataFrame:
    """The messages of the sessions whose id starts with `prefix`, in order; none for an empty prefix."""
    rows = messages.where(has_prefix(prefix) if prefix else F.lit(False))
    if role:
        rows = rows.where(F.col("role") == role)
    rows = rows.orderBy("tool", "session_id", F.coalesce("ts", F.lit(0.0)), "id")
    rows = rows.limit(limit) if limit > 0 else rows
    return rows.select("tool", "session_id", "id", format_timestamp(F.col("ts")).alias("time"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def transcript(messages: DataFrame, prefix: str, *, tool: str = "", cwd: str = "", after: float | None = None) -> DataFrame:
    """The messages of a session (or of all whose id starts with `prefix`), in order; a source's folder is that of its session."""
    folders = session_rollup(messages).select(*PHYSICAL, F.col("cwd").alias("session_cwd"))
    rows = messages.where(has_prefix(prefix))
    if tool:
        rows = rows.where(F.col("tool") == tool)
    if after is not None:
        rows = rows.where(F.col("ts") >= after)
    if cwd:
        rows = rows.join(folders.where(T.ascii_lower(F.col("session_cwd")).contains(T.ascii_lower_of(cwd))), PHYSICAL, "left_semi")
    return rows.orderBy(F.coalesce("ts", F.lit(0.0)), "id")


def last_round_shown(messages: DataFrame) -> DataFrame:
    """Per session the last user and assistant texts that are not blank, noise included and whole."""
    said = F.lower(T.trim_white(F.col("role")))
    m = messages.withColumns({"said": said, "body": T.trim_white(F.col("text"))}).where("body <> '' AND said IN ('user', 'assistant')")
    newest = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), "id", "body")
    return m.groupBy(*LOGICAL).agg(*[F.coalesce(F.max(F.when(F.col("said") == r, newest))["body"], F.lit("")).alias(f"last_{r}") for r in ("user", "assistant")])


def recent(messages: DataFrame, *, tool: str | None = None, cwd: str | None = None, after: float | None = None, limit: int = 100) -> DataFrame:
    """The physical sessions last updated."""
    s = session_rollup(messages)
    if tool:
        s = s.where(F.col("tool") == tool)
    if cwd:
        s = s.where(T.ascii_lower(F.col("cwd")).contains(T.ascii_lower_of(cwd)))
    if after is not None:
        s = s.where(F.col("updated") >= after)
    ranked = s.orderBy(F.coalesce("updated", "created", F.lit(0.0)).desc(), "tool", "session_id", "source_path").limit(limit)
    return ranked.select(*PHYSICAL, "title", format_timestamp(F.col("updated")).alias("updated"), "n_messages")


def last_rounds(messages: DataFrame) -> DataFrame:
    """Per logical session the newest user and assistant texts that are no noise. Only one text per session and role is ever held."""
    body = T.trim_white(F.col("text"))
    m = messages.where(F.col("role").isin("user", "assistant")).withColumn("body", body).where((F.col("body") != "") & ~T.is_tool_noise(F.col("text")))
    newest = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), "id", T.clip(F.col("body"), LAST_ROUND_CHARS).alias("body"))
    return m.groupBy(*LOGICAL).agg(*[F.coalesce(F.max(F.when(F.col("role") == r, newest))["body"], F.lit("")).alias(f"last_{r}") for r in ("user", "assistant")])


def recent_with_rounds(messages: DataFrame, **options: object) -> DataFrame:
    """recent() with the last user and assistant texts of each session; these are looked for in the sessions listed only."""
    listed = recent(messages, **options)
    keys = F.broadcast(listed.select(*LOGICAL).distinct())  # as few as the limit says
    rounds = last_rounds(messages.join(keys, LOGICAL, "left_semi"))
    out = listed.join(F.broadcast(rounds), LOGICAL, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("last_user", "last_assistant")})
