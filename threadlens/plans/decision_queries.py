"""Queries on decisions, evidence and judgments. The tables' talk decides nothing, so a script of sentences is dealt over its messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decision_patterns as P
from ..functions import regexes as R
from ..functions import text as T
from ..operators import decision_fold, decisions, skills, windows
from .registry import KEYS, register
from .search_sql import quoted
from .tables import MESSAGES_SQL, messages, table

SCRIPT = [
    "We choose SQLite over Postgres because it is simple.",
    "Implemented the SQLite storage.",
    "Yes, go ahead.",
    "We picked Redis instead of Kafka since it is fast enough.",
    "PLEASE DO THIS NOW: RUN ALL THE TESTS",
    "The sqlite3 module is what I would adopt.",
    "All tests passed for the SQLite storage.",
    "<environment_context>x</environment_context> We choose YAML over TOML because of comments.",
    "Nothing to see here. We recommend gRPC rather than REST because of streaming.",
    "Looks good, thanks.",
    "We choose this way over that one because it is known.",
]


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, users and assistants by turns, each saying a line of the script."""
    line = F.element_at(F.array(*map(F.lit, SCRIPT)), (F.col("id") * 7 % len(SCRIPT) + 1).cast("int"))
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    return messages(spark, sf_dir).withColumns({"text": line, "role": role})


TALK_SQL = f"""{MESSAGES_SQL}, t AS (SELECT *, (id * 7 % {len(SCRIPT)})::INT AS line, CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS who, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) AS "at" FROM m)"""

#: What the lines of the script decide, worked out by hand: line, ordinal, options, chosen, rationale, confidence.
_DECIDED = [
    (0, 0, "SQLite|Postgres", "SQLite", "it is simple", 0.85),
    (3, 0, "", "", "it is fast enough", 0.65),
    (8, 1, "gRPC", "gRPC", "of streaming", 0.85),
    (10, 0, "this way|that one", "this way", "it is known", 0.85),
]
_DECIDED_SQL = "d(line, ordinal, options, chosen, rationale, confidence) AS (VALUES " + ", ".join(f"({a}, {b}, {quoted(c)}, {quoted(d)}, {quoted(e)}, {f}::DOUBLE)" for a, b, c, d, e, f in _DECIDED) + ")"


@register(f"WITH {TALK_SQL}, {_DECIDED_SQL} SELECT tool, session_id, \"at\", ordinal, options, chosen, rationale, confidence FROM t JOIN d USING (line)")
def decision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions.candidates(talk(spark, sf_dir), KEYS)
    return found.select(*KEYS, "at", "ordinal", F.array_join("options", "|").alias("options"), "chosen", "rationale", "confidence")


@register(f"WITH {TALK_SQL}, {_DECIDED_SQL} SELECT tool, session_id, \"at\", chosen FROM t JOIN d USING (line) WHERE line IN (0, 8)")
def decisions_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only decisions whose choice names something."""
    return decisions.candidates(talk(spark, sf_dir), KEYS, resolved_only=True).select(*KEYS, "at", "chosen")


# A confirmation belongs to the decision before it, with no more than three messages between it and what it follows.
@register(
    f"""WITH {TALK_SQL}, {_DECIDED_SQL}, r AS (SELECT tool, session_id, "at", line IN (SELECT line FROM d) AS decides FROM t WHERE line IN (SELECT line FROM d) OR who = 'user' AND line IN (2, 9)),
g AS (SELECT *, decides OR coalesce("at" - lag("at") OVER (PARTITION BY tool, session_id ORDER BY "at") > 3, true) AS starts FROM r),
i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY tool, session_id ORDER BY "at") AS island FROM g),
f AS (SELECT *, max(CASE WHEN decides THEN "at" END) OVER (PARTITION BY tool, session_id, island) AS decided_at FROM i)
SELECT tool, session_id, "at", decided_at FROM f WHERE NOT decides AND decided_at IS NOT NULL"""
)
def decision_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = talk(spark, sf_dir)
    found = decisions.candidates(m, KEYS)
    return decisions.confirmations(m, found, KEYS).join(found.select("decision_id", F.col("at").alias("decided_at")), "decision_id").select(*KEYS, "at", "decided_at")


# Of the lines that report work, both speak of SQLite, as only the first line does that decides.
@register(
    f"""WITH {TALK_SQL}, i AS (SELECT * FROM t WHERE who = 'assistant' AND line IN (1, 6))
SELECT i.tool, i.session_id, i."at", max(d."at") AS decided_at, CASE WHEN i.line = 6 THEN 'test' ELSE 'implementation' END AS kind, 'implemented' AS outcome
FROM i JOIN t AS d ON d.tool = i.tool AND d.session_id = i.session_id AND d.line = 0 AND d."at" < i."at" AND i."at" - d."at" <= 4 GROUP BY ALL"""
)
def decision_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = talk(spark, sf_dir)
    found = decisions.candidates(m, KEYS)
    return decisions.implementations(m, found, KEYS).join(found.select("decision_id", F.col("at").alias("decided_at")), "decision_id").select(*KEYS, "at", "decided_at", "kind", "outcome")


# Lines 0 and 10 share words, and each line shares them with itself; others do not.
@register(
    f"""WITH RECURSIVE {TALK_SQL}, {_DECIDED_SQL}, c AS (SELECT tool, session_id, "at", who, CASE WHEN line = 10 THEN 0 ELSE line END AS topic, confidence FROM t JOIN d USING (line)),
up AS (SELECT c.tool, c.session_id, c."at", max(e."at") AS above FROM c LEFT JOIN c AS e ON e.tool = c.tool AND e.session_id = c.session_id AND e.topic = c.topic AND e.who <> c.who AND e."at" < c."at" AND c."at" - e."at" <= 2 GROUP BY ALL),
r AS (SELECT tool, session_id, "at", "at" AS root FROM up WHERE above IS NULL UNION ALL SELECT up.tool, up.session_id, up."at", r.root FROM up JOIN r ON up.tool = r.tool AND up.session_id = r.session_id AND up.above = r."at")
SELECT tool, session_id, min("at") AS message_start, max("at") AS message_end, max(confidence) AS confidence, count(*) AS n_members FROM r JOIN c USING (tool, session_id, "at") GROUP BY tool, session_id, root"""
)
def decisions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions.merged(decisions.candidates(talk(spark, sf_dir), KEYS), KEYS)
    return found.select(*KEYS, "message_start", "message_end", "confidence", F.size("members").cast("long").alias("n_members"))


@register(
    f"""WITH {TALK_SQL}, {_DECIDED_SQL}, c AS (SELECT *, "at" % 4 AS j FROM t JOIN d USING (line))
SELECT tool, session_id, "at", CASE WHEN j = 2 AND chosen <> '' THEN greatest(confidence, 0.9) ELSE confidence END AS confidence FROM c WHERE j <> 1"""
)
def decisions_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions after judgments: by their place, some are suppressed, some raised, some to be reviewed, some not judged."""
    found = decisions.candidates(talk(spark, sf_dir), KEYS)
    verdict = F.when(F.col("at") % 4 == 1, "Suppress").when(F.col("at") % 4 == 2, " draft").when(F.col("at") % 4 == 3, "review")
    judged = found.select("decision_id", verdict.alias("disposition"), F.lit(0.9).alias("judged"), F.array(F.lit("r")).alias("reason_codes")).where("disposition IS NOT NULL")
    return decisions.apply_judgments(found, judged).select(*KEYS, "at", "confidence")


@register(f"WITH {TALK_SQL} SELECT id FROM t WHERE line IN (4, 7)")
def noise_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are no part of the talk as a whole: injected texts and instructions in capitals."""
    return talk(spark, sf_dir).where(decisions.is_noise_message(F.col("text"))).select("id")


@register(f"WITH {TALK_SQL} SELECT id FROM t WHERE line IN (0, 3, 5, 7, 8, 10)")
def decision_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).where(T.matches(F.col("text"), P.STRONG_CUE)).select("id")


_CHOICES = ["SQLite", "the SQLite", "it", "this way", "We chose", "json", "使用案例", "方案", "a skill", "it up", "x" * 81, "Rust because", " `Go`, ", "不用"]
_USABLE = [True, False, False, False, False, False, True, False, False, False, False, False, True, True]


@register(f"WITH c AS (SELECT p_partkey, [{', '.join(str(v).lower() for v in _USABLE)}][(p_partkey % {len(_USABLE)} + 1)::INT] AS ok FROM part) SELECT p_partkey, ok AND p_partkey % 3 <> 2 AS usable FROM c")
def usable_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as choices; those of every third are none of their options."""
    k = F.col("p_partkey").cast("long")
    chosen = F.element_at(F.array(*map(F.lit, _CHOICES)), (k % len(_CHOICES) + 1).cast("int"))
    options = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("other"), F.upper(chosen))).otherwise(F.array(F.lit("other")))
    return table(spark, sf_dir, "part").select("p_partkey", decisions.is_usable_chosen(chosen, options).alias("usable"))


# Shape -----------------------------------------------------------------------------------------------------------------------------------


@register(
    """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, CASE WHEN k % 2 = 0 AND k % 5 <> 1 THEN 'unknown' WHEN k % 2 = 0 THEN 'implemented' ELSE 'planned' END AS outcome,
CASE WHEN k % 7 = 1 THEN 'status' WHEN k % 7 = 2 THEN 'context' WHEN k % 11 = 3 THEN 'confidence' WHEN k % 7 = 3 THEN 'supersedes' WHEN k % 13 = 4 THEN 'option' WHEN k % 5 = 2 THEN 'evidence kind' WHEN k % 5 = 3 THEN 'evidence quote' WHEN k % 17 = 5 THEN 'session' END AS problem FROM o"""
)
def decision_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions with one fault or another."""
    k = F.col("o_orderkey").cast("long")
    kind = F.when(k % 5 == 1, " Test ").when(k % 5 == 2, "rumour").otherwise("transcript")
    evidence = F.array(F.struct(kind.alias("kind"), F.when(k % 5 == 3, " short ").otherwise("long enough").alias("quote"), F.lit(1).alias("message_index")))
    d = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.lit("").alias("kind"), F.when(k % 7 == 1, "odd").when(k % 7 == 3, "superseded").otherwise(" ").alias("status"), F.when(k % 2 == 0, "implemented").otherwise("planned").alias("outcome"),
        F.when(k % 7 == 2, " ").otherwise("why").alias("context"), F.when(k % 11 == 3, 1.5).otherwise(0.5).alias("confidence"), F.lit("").alias("supersedes"), F.when(k % 13 == 4, F.array(F.lit("a"), F.lit(" "))).alias("options"),
        evidence.alias("evidence"), F.when(k % 17 == 5, "").otherwise("s").alias("session_id"),
    )
    return decisions.problem(d).select("k", "outcome", "problem")


# Evidence and bundles --------------------------------------------------------------------------------------------------------------------

_EVIDENCE_SQL = f"""{TALK_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) - 1 AS message_index FROM t WHERE line <> 7),
e AS (SELECT *, 'acceptance' AS kind, 0 AS nth FROM k WHERE who = 'user' AND line IN (2, 9) UNION ALL SELECT *, 'tests_passed', 1 FROM k WHERE line = 6),
n AS (SELECT *, 'evidence-' || row_number() OVER (PARTITION BY tool, session_id ORDER BY message_index, nth) AS evidence_id FROM e)"""


@register(f"WITH {_EVIDENCE_SQL} SELECT tool, session_id, evidence_id, kind, message_index, who AS role, source_path FROM n")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.evidence(talk(spark, sf_dir), KEYS).drop("summary")


@register(f"WITH {_EVIDENCE_SQL}, f AS (SELECT tool, session_id, kind, min(message_index) AS first FROM n GROUP BY ALL) SELECT tool, session_id, string_agg(kind, '|' ORDER BY first) AS kinds FROM f GROUP BY ALL")
def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.evidence_kinds(skills.evidence(talk(spark, sf_dir), KEYS), KEYS)


@register(
    f"""WITH {_EVIDENCE_SQL}, g AS (SELECT tool, session_id, count(*) AS c, max(id // 1000) AS conv, arg_min(evidence_id, message_index) AS first_id FROM n GROUP BY ALL),
r AS (SELECT *, CASE WHEN conv % 3 = 0 THEN first_id ELSE 'evidence-2' END AS wanted FROM g WHERE c >= 2)
SELECT n.tool, n.session_id, n.evidence_id, CASE WHEN n.evidence_id = wanted THEN 2 ELSE 1 END AS part FROM n JOIN r USING (tool, session_id)"""
)
def split_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of evidence is split off every bundle that has two: the first, or the second."""
    found = skills.evidence(talk(spark, sf_dir), KEYS)
    asked = found.select(*KEYS).distinct().withColumn("evidence_id", F.when(F.substring("session_id", 6, 6).cast("long") % 3 == 0, "").otherwise("evidence-2"))
    return skills.split_evidence(found, asked, KEYS)[1].select(*KEYS, "evidence_id", "part")


@register(
    """WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k, CASE WHEN k % 2 = 0 THEN 's-' || k ELSE '' END = '' AND k % 5 = 0 AS incomplete,
CASE WHEN k % 5 = 4 THEN 'draft' WHEN k % 5 = 1 OR (k % 5 <> 2 AND (k % 3 = 0 OR k % 7 = 0)) THEN 'suppress' ELSE 'draft' END AS disposition,
round(CASE WHEN k % 5 = 4 THEN 0.6 WHEN k % 5 = 1 OR (k % 5 <> 2 AND (k % 3 = 0 OR k % 7 = 0)) THEN 0.0 WHEN k % 5 IN (0, 3) AND k % 2 = 0 THEN 0.8 ELSE 0.6 END, 6) AS score FROM p"""
)
def judged_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bundles, four of five of which are judged; some have no slug, some risks that the judgment raises, some no evidence."""
    k = F.col("p_partkey").cast("long")
    b = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 2 == 0, F.concat(F.lit("s-"), k)).otherwise("").alias("slug"), F.lit("t").alias("trigger"), F.lit("i").alias("instructions"), F.lit("draft").alias("disposition"), F.lit(0.6).alias("score"),
        F.lit(0.6).alias("confidence"), F.lit(0.1).alias("one_off_risk"), F.lit(0.0).alias("secret_risk"), F.lit("").alias("reasons"), F.when(k % 7 == 0, "").otherwise("acceptance").alias("success_evidence"), F.lit("draft").alias("action"),
    )
    verdict = F.when(F.col("k") % 5 == 1, "suppress").when(F.col("k") % 5 == 2, "review").otherwise("draft")
    told = b.where("k % 5 <> 4").select("k", verdict.alias("verdict"), F.lit(0.8).alias("judged"), F.when(F.col("k") % 3 == 0, 0.9).otherwise(0.0).alias("judged_one_off"), F.lit(0.0).alias("judged_secret"), F.array(F.lit("x")).alias("reason_codes"))
    out = skills.apply_judgments(b, told, ["k"])
    return out.select("k", ((F.col("slug") == "") & (F.col("k") % 5 == 0)).alias("incomplete"), "disposition", F.round("score", 6).alias("score"))


@register(
    f"""WITH b AS (SELECT doc_id, text, length(regexp_replace(regexp_replace(text, {quoted(R.SECRET_TOKEN)}, ''), 'x', '')) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 5 = 0 THEN 'suppressed' WHEN {' OR '.join(f"regexp_matches(text, {quoted(p)})" for p in R.SECRETS)} THEN 'sensitive' ELSE 'ok' END AS outcome FROM b"""
)
def publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as instructions: some bundles are suppressed or without evidence, some hold a secret."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("slug").alias("slug"), F.lit("t").alias("trigger"), F.col("text").alias("instructions"), F.when(F.col("doc_id") % 4 == 1, "suppress").otherwise("draft").alias("disposition"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("acceptance").alias("success_evidence"), F.lit(0.1).alias("one_off_risk"), F.lit(0.0).alias("secret_risk"))
    return skills.publish_outcome(d).select("doc_id", "outcome")


_DOCUMENTS = [
    ('---\nname: "good-one"\ndescription: "Use \\"it\\"."\n---\n\n# Body\n', "good-one", None), ("", "", "empty"), ("no\n\n\n\n", "", "no opening"), ("---\nname: a\nx\n", "", "no closing"),
    ("---\nname: a\njust text\n---\nbody", "", "malformed line"), ("---\nname: a\nversion: 1\n---\nbody", "", "unsupported key"), ("---\ndescription: d\n# c\n---\nbody", "", "name"), ("---\nname: a\nname: b\ndescription: d\n---\nbody", "", "name"),
    ("---\nname: a\n---\nbody", "", "description"), ('---\nname: a\ndescription: "d\n---\nbody', "", "quoting"), ("---\nname: A b\ndescription: d\n---\nbody", "", "slug"), ("---\nname: a\ndescription: d\n---\nbody", "b", "other name"),
    ("---\r\nname: a\r\ndescription: d\r\n---\r\n \r\n", "a", "no body"), ("---\nname: a\ndescription: d\n---\npassword = hunter2hunter2", "a", "sensitive"),
]


@register("SELECT p_partkey, [" + ", ".join("'none'" if p is None else quoted(p) for _, _, p in _DOCUMENTS) + f"][(p_partkey % {len(_DOCUMENTS)} + 1)::INT] AS problem FROM part")
def skill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills' text forms, most of them with a fault."""
    n = (F.col("p_partkey") % len(_DOCUMENTS) + 1).cast("int")
    document, expected = (F.element_at(F.array(*[F.lit(d[i]) for d in _DOCUMENTS]), n) for i in (0, 1))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(skills.parse_markdown(document, expected)["problem"], F.lit("none")).alias("problem"))


@register("SELECT count(*) FILTER (o_orderkey % 3 = 1) AS n FROM orders")
def segment_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("x"), F.lit("segment:fallback:missing_index:2"))).otherwise(F.array(F.lit("segment:other")))
    return skills.fallbacks(table(spark, sf_dir, "orders").select(some.alias("reasons")))


@register()
def decisions_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by the exact fold, with what later messages add to them; a test folds whole lists."""
    found = decision_fold.folded(talk(spark, sf_dir), KEYS)
    return found.select("decision_id", *KEYS, "message_start", "message_end", "chosen", "confidence", "outcome", F.size("evidence").alias("n_evidence"), F.array_join("members", "|").alias("members"))


# Answers on windows of three user turns that overlap by one; some turns are left out, some windows fail, some sessions have no turns. ------

_N = "c + window * 3 + index"


def _answered_windows(spark: SparkSession, sf_dir: str):
    m = messages(spark, sf_dir).where((F.col("role") == "user") & (F.col("id") % 7000 >= 1000))
    sessions = messages(spark, sf_dir).select(*KEYS).distinct()
    w = windows.turn_windows(m, KEYS, size=3, overlap=1)
    each = w.withColumn("c", F.substring("session_id", 6, 6).cast("long")).withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") + 1)))
    # Of two answers on a turn the later one counts; answers beyond the window count for nothing.
    answers = each.where(f"({_N}) % 5 <> 0").select(*KEYS, "window", "index", F.when(F.expr(f"({_N}) % 3 = 0"), "new").otherwise("same").alias("decision"), F.lit(2).alias("place"))
    answers = answers.unionAll(each.where(f"({_N}) % 5 <> 0").select(*KEYS, "window", "index", F.lit("new").alias("decision"), F.lit(1).alias("place")))
    errors = each.where("c % 9 = 4 AND window >= 1 AND index = 0").select(*KEYS, "window", F.format_string("no answer on %d", "window").alias("error"))
    return skills.turns_of_answers(sessions, w, answers, errors, KEYS)


_WINDOWS_SQL = f"""{MESSAGES_SQL}, u AS (SELECT tool, session_id, count(*) AS n FROM m WHERE role = 'user' AND id % 7000 >= 1000 GROUP BY tool, session_id),
w AS (SELECT *, unnest(range(greatest(0, ceil((n - 3) / 2.0))::BIGINT + 1)) AS win, substr(session_id, 6)::BIGINT AS c FROM u),
i AS (SELECT *, least(3, n - win * 2) AS turns, unnest(range(least(3, n - win * 2))) AS ix FROM w),
d AS (SELECT *, win * 2 + ix AS turn, CASE WHEN (c + win * 3 + ix) % 5 = 0 THEN NULL WHEN (c + win * 3 + ix) % 3 = 0 THEN 'new' ELSE 'same' END AS decision, max(CASE WHEN c % 9 = 4 AND win >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tool, session_id) AS failed FROM i)"""


@register(f"WITH {_WINDOWS_SQL} SELECT tool, session_id, turn, CASE WHEN turn = 0 THEN 'new' ELSE coalesce(decision, 'same') END AS decision FROM d WHERE failed = 0 AND (win = 0 OR ix >= 1)")
def turns_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered_windows(spark, sf_dir)[0]


@register(
    f"""WITH {_WINDOWS_SQL} SELECT tool, session_id, 'missing_index' AS kind, count(*) AS count, win * 2 AS window_start, win * 2 + max(turns) - 1 AS window_end, '' AS message FROM d WHERE decision IS NULL AND (failed = 0 OR win < 1) GROUP BY tool, session_id, win
UNION ALL SELECT DISTINCT tool, session_id, 'segmenter_error', 1, 0, 0, 'no answer on 1' FROM d WHERE failed = 1
UNION ALL SELECT DISTINCT tool, session_id, 'empty_result', 1, 0, 0, '' FROM m WHERE session_id NOT IN (SELECT session_id FROM u)"""
)
def segment_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was repaired in the answers on windows, and sessions that stay whole."""
    return _answered_windows(spark, sf_dir)[1]


@register(
    f"""WITH {_WINDOWS_SQL}, k AS (SELECT session_id FROM d WHERE decision IS NULL AND (failed = 0 OR win < 1) UNION SELECT session_id FROM d WHERE failed = 1 UNION SELECT session_id FROM m WHERE session_id NOT IN (SELECT session_id FROM u))
SELECT count(*) AS n FROM k"""
)
def segment_fallbacks_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions' candidates were segmented by a fallback, by the reasons made from answers."""
    return skills.fallbacks(skills.fallback_reasons(_answered_windows(spark, sf_dir)[1], KEYS))


# Every conversation has a decision with two pieces of evidence: words of its second message, and words that nobody said. A third of the
# decisions names no source, a third one of the two sources, a third one that is gone; half of these have no stored quotes.
_QUOTES_SQL = f"""{MESSAGES_SQL}, q AS (SELECT conv_id AS c, coalesce(substr(max(CASE WHEN turn = 1 THEN text END), 3, 25), '') AS quote FROM conversations GROUP BY conv_id),
d AS (SELECT *, CASE c % 3 WHEN 0 THEN '' WHEN 1 THEN '/src/' || c || '/1' ELSE '/gone' END AS source, CASE WHEN c % 3 = 2 AND c % 2 = 1 THEN '' ELSE quote END AS first_quote, CASE WHEN c % 3 = 2 AND c % 2 = 1 THEN '' ELSE 'words that nobody said' END AS other_quote FROM q),
here AS (SELECT d.c, m.role, m.text FROM d JOIN m ON m.session_id = printf('conv-%06d', c) AND (source = '' OR source = m.source_path)),
stored AS (SELECT c, unnest([first_quote, other_quote]) AS text, unnest([CASE WHEN c % 4 = 0 THEN 'user' ELSE 'assistant' END, 'assistant']) AS role FROM d WHERE c NOT IN (SELECT c FROM here)),
known AS (SELECT c, role, text, 'session' AS origin FROM here UNION ALL SELECT c, role, text, 'evidence' FROM stored WHERE trim(text, E' \\n\\t\\r') <> ''),
asked AS (SELECT c, 0 AS k, first_quote AS quote, c % 4 = 0 AS explicit FROM d UNION ALL SELECT c, 1, other_quote, false FROM d),
hits AS (SELECT asked.c, k, bool_or(known.role = 'user') AS by_user FROM asked JOIN known ON known.c = asked.c AND contains(known.text, quote) WHERE length(trim(quote, E' \\n\\t\\r')) >= {P.LEAST_QUOTE} GROUP BY asked.c, k)"""


@register(
    f"""WITH {_QUOTES_SQL}
SELECT 'd' || d.c AS decision_id, coalesce((SELECT max(origin) FROM known WHERE known.c = d.c), 'none') AS origin, (SELECT count(*) FROM known WHERE known.c = d.c) AS n_messages,
  (SELECT string_agg(CASE WHEN length(trim(quote, E' \\n\\t\\r')) < {P.LEAST_QUOTE} THEN 'too_short' WHEN hits.by_user IS NULL THEN 'not_found' WHEN explicit AND NOT hits.by_user THEN 'wrong_role' ELSE 'ok' END, '|' ORDER BY asked.k)
   FROM asked LEFT JOIN hits ON hits.c = asked.c AND hits.k = asked.k WHERE asked.c = d.c) AS outcomes FROM d"""
)
def review_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decisions are reviewed against, and whether their evidence stands in it."""
    c = F.col("conv_id").cast("long").alias("c")
    q = table(spark, sf_dir, "conversations").groupBy(c).agg(F.coalesce(F.substring(F.max(F.when(F.col("turn") == 1, F.col("text"))), 3, 25), F.lit("")).alias("quote"))
    bare = (F.col("c") % 3 == 2) & (F.col("c") % 2 == 1)
    source = F.when(F.col("c") % 3 == 0, "").when(F.col("c") % 3 == 1, F.concat(F.lit("/src/"), "c", F.lit("/1"))).otherwise("/gone")
    explicit = F.when(F.col("c") % 4 == 0, "explicit").otherwise("transcript")
    piece = lambda kind, quote: F.struct(kind.alias("kind"), F.when(bare, "").otherwise(quote).alias("quote"), F.lit("").alias("role"))
    decided = q.select(
        F.concat(F.lit("d"), "c").alias("decision_id"), F.format_string("conv-%06d", "c").alias("session_id"), source.alias("source_path"),
        F.array(piece(explicit, F.col("quote")), piece(F.lit("transcript"), F.lit("words that nobody said"))).alias("evidence"),
    )
    found = decisions.check_review(decided, messages(spark, sf_dir))
    return found.withColumn("outcomes", F.array_join("outcomes", "|"))
