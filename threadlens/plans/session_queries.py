"""Queries that show, list and load sessions, find sources, and mark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental, sessions, skills
from ..sinks.results import json_line
from .registry import KEYS, register
from .search_sql import ROLLUP_SQL, TIME_SQL
from .tables import MESSAGES_SQL, messages, table


@register(
    f"""WITH {MESSAGES_SQL} SELECT tool, session_id, id, {TIME_SQL.format('ts')} AS time, role, text FROM m WHERE starts_with(session_id, 'conv-0000')
ORDER BY tool, session_id, ts, id LIMIT 40"""
)
def show_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.show(messages(spark, sf_dir), "cOnV-0000", limit=40)


@register(f"WITH {MESSAGES_SQL} SELECT id, tool, session_id, role, text FROM m WHERE starts_with(session_id, 'conv-00001') AND tool = 'grok' AND contains(cwd, 'k/p') AND ts >= 1704067200.0 + 600 * 11")
def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.transcript(messages(spark, sf_dir), "CONV-00001", tool="grok", cwd="K/P", after=1704067200.0 + 600 * 11)
    return found.select("id", "tool", "session_id", "role", "text")


@register(
    rf"""WITH {MESSAGES_SQL}, b AS (SELECT *, trim(text, E' \n\t\r') AS body FROM m WHERE role IN ('user', 'assistant') AND trim(text, E' \n\t\r') <> '')
SELECT tool, session_id, md5(coalesce(arg_max(body, id) FILTER (role = 'user'), '')) AS last_user, md5(coalesce(arg_max(body, id) FILTER (role = 'assistant'), '')) AS last_assistant FROM b GROUP BY ALL"""
)
def last_rounds_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = sessions.last_round_shown(messages(spark, sf_dir))
    return last.select(*KEYS, *[F.md5(c).alias(c) for c in ("last_user", "last_assistant")])


_NOW = 1704067200.0 + 86400 * 45


@register(
    f"""WITH t AS (SELECT o_orderkey, 1704067200.0::DOUBLE + o_orderkey * o_orderkey * 7 AS "at" FROM orders),
d AS (SELECT *, abs({_NOW} - "at")::BIGINT AS s, "at" > {_NOW} AS ahead FROM t),
v AS (SELECT *, CASE WHEN s < 60 THEN '' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 2592000 THEN (s // 86400) || 'd' WHEN s < 31536000 THEN (s // 2592000) || 'mo' ELSE (s // 31536000) || 'y' END AS v FROM d)
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '-' WHEN v = '' THEN 'just now' WHEN ahead THEN 'in ' || v ELSE v || ' ago' END AS told FROM v"""
)
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points in time around now; every tenth has none."""
    o = table(spark, sf_dir, "orders")
    at = F.lit(1704067200.0) + F.col("o_orderkey").cast("long") * F.col("o_orderkey").cast("long") * 7
    at = F.when(F.col("o_orderkey") % 10 != 0, at)
    return o.select("o_orderkey", T.relative_time(at, F.lit(_NOW)).alias("told"))


@register("SELECT conv_id, turn, md5(regexp_replace(text, '(?i)(thation|the|on)', '[\\1]', 'g')) AS marked_md5 FROM conversations")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.highlight(F.col("text"), ["on", "THE", "thation"], "[", "]")).alias("marked_md5"))


_TERMS = ["leon", "thatble", "ing"]


@register(
    rf"""WITH {MESSAGES_SQL}, c AS (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM m),
p AS (SELECT *, (SELECT min(x) FROM unnest([instr(lower(flat), 'leon'), instr(lower(flat), 'thatble'), instr(lower(flat), 'ing')]) AS t(x) WHERE x > 0) - 1 AS hit, length(flat) AS n FROM c),
w AS (SELECT *, greatest(0, least(hit - 20, n - 60)) AS start FROM p)
SELECT id, CASE WHEN n <= 60 THEN flat WHEN hit IS NULL THEN substr(flat, 1, 59) || '…'
  ELSE CASE WHEN start > 0 THEN '…' || substr(flat, start + 2, CASE WHEN start + 60 < n THEN 58 ELSE 59 END) ELSE substr(flat, 1, 59) END || CASE WHEN start + 60 < n THEN '…' ELSE '' END END AS snippet FROM w"""
)
def message_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts around the earliest hit of three terms."""
    return messages(spark, sf_dir).select("id", T.snippet(F.col("text"), _TERMS, 60).alias("snippet"))


# Sources ---------------------------------------------------------------------------------------------------------------------------------

_SOURCES_SQL = """src AS (SELECT ['grok', 'opencode', 'codex'][(o_orderkey % 3 + 1)::INT] AS tool, '/s/' || o_orderkey || '/f' AS source_path, o_orderkey AS k FROM orders),
files AS (SELECT source_path AS path, k * 1.0::DOUBLE AS mtime, k AS size, k FROM src WHERE k % 7 <> 0
  UNION ALL SELECT '/s/' || k || '/summary.json', k + 5.0::DOUBLE, 10, k FROM src WHERE k % 2 = 0 UNION ALL SELECT source_path || '-wal', k + 9.0::DOUBLE, 100, k FROM src WHERE k % 5 = 0)"""


@register(
    f"""WITH {_SOURCES_SQL}, j AS (SELECT src.tool, src.source_path, files.mtime, files.size FROM src LEFT JOIN files ON files.k = src.k AND
  (files.path = src.source_path OR tool = 'grok' AND ends_with(files.path, 'summary.json') OR tool = 'opencode' AND ends_with(files.path, '-wal')))
SELECT tool, source_path, coalesce(max(mtime), 0.0) AS mtime, coalesce(sum(size), 0)::BIGINT AS size FROM j GROUP BY ALL"""
)
def source_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcripts, with files beside some of them; some are gone."""
    key = F.col("o_orderkey").cast("long").alias("k")
    src = table(spark, sf_dir, "orders").select(key).select(
        F.element_at(F.array(*map(F.lit, ["grok", "opencode", "codex"])), (F.col("k") % 3 + 1).cast("int")).alias("tool"), F.concat(F.lit("/s/"), "k", F.lit("/f")).alias("source_path"), "k"
    )

    def beside(name: str, more: float, size: int, every: int) -> DataFrame:
        path = F.concat(F.lit("/s/"), "k", F.lit(name))
        return src.where(F.col("k") % every == 0).select(path.alias("path"), (F.col("k") + more).cast("double").alias("mtime"), F.lit(size).cast("long").alias("size"))

    own = src.where("k % 7 <> 0").select(F.col("source_path").alias("path"), F.col("k").cast("double").alias("mtime"), F.col("k").alias("size"))
    files = own.unionByName(beside("/summary.json", 5.0, 10, 2)).unionByName(beside("/f-wal", 9.0, 100, 5))
    return incremental.signatures(files, src)


_QUEUED_SQL = "c AS (SELECT DISTINCT CASE WHEN id % 2000 < 1000 THEN '' ELSE tool END AS tool, session_id FROM m WHERE id % 3000 < 1000)"


def _queued(m: DataFrame) -> DataFrame:
    return m.where("id % 3000 < 1000").select(F.when(F.col("id") % 2000 < 1000, "").otherwise(F.col("tool")).alias("tool"), "session_id")


@register(
    f"""WITH {MESSAGES_SQL}, {ROLLUP_SQL}, {_QUEUED_SQL}
SELECT tool, session_id, title, cwd, source_path, {TIME_SQL.format('created')} AS created, {TIME_SQL.format('updated')} AS updated FROM roll
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = roll.session_id AND (c.tool = '' OR c.tool = roll.tool)) AND contains(cwd, '/p') AND roll.updated >= 1704070000.0"""
)
def pending_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return incremental.list_pending(sessions.session_rollup(m), _queued(m), prefix="Conv", cwd="/P", after=1704070000.0)


@register(
    f"""WITH {MESSAGES_SQL}, {_QUEUED_SQL}, p AS (SELECT DISTINCT tool, session_id, source_path FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = m.session_id AND (c.tool = '' OR c.tool = m.tool))),
said AS (SELECT tool, session_id, count(*) FILTER (role IN ('user', 'assistant') AND trim(text, E' \\n\\t\\r') <> '') AS n FROM m GROUP BY ALL)
SELECT tool, session_id, source_path, n = 0 AS failed, CASE WHEN n = 0 THEN 'empty-session-' || session_id END AS marker FROM p JOIN said USING (tool, session_id)"""
)
def extract_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for every pending source; a conversation in seven is made of system messages only."""
    m = messages(spark, sf_dir)
    made = skills.extract_pending(m, sessions.session_rollup(m), _queued(m), spark.createDataFrame([], "slug string"), KEYS)
    failed = F.col("status") == "failed"
    return made.select(*KEYS, "source_path", failed.alias("failed"), F.when(failed, F.col("slug")).alias("marker"))


# Tasks and evidence ----------------------------------------------------------------------------------------------------------------------


@register(
    f"""WITH {MESSAGES_SQL}, n AS (SELECT tool, session_id, count(*) AS n FROM m WHERE role = 'user' GROUP BY ALL), every AS (SELECT tool, session_id, unnest(range(n)) AS turn FROM n)
SELECT tool, session_id, turn, CASE WHEN turn = 0 OR turn % 3 = 1 THEN 'new' ELSE 'same' END AS decision, turn % 3 = 2 AS missing FROM every"""
)
def repaired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on user turns of which every third is missing, and one in three of the rest is new."""
    n = messages(spark, sf_dir).where("role = 'user'").groupBy(*KEYS).agg(F.count("*").alias("n"))
    told = n.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn")).where("turn % 3 <> 2")
    told = told.withColumn("decision", F.when(F.col("turn") % 3 == 1, "new").otherwise("same"))
    return skills.repaired_turns(told, n, KEYS)


@register(
    f"""WITH {MESSAGES_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) - 1 AS i FROM m WHERE role IN ('user', 'assistant') AND trim(text, E' \\n\\t\\r') <> ''),
t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY tool, session_id ORDER BY i) - 1 AS turn FROM u),
s AS (SELECT *, sum((role = 'user' AND (turn = 0 OR turn % 3 = 1))::INT) OVER (PARTITION BY tool, session_id ORDER BY i) AS segment, max(turn) OVER (PARTITION BY tool, session_id) < 0 AS whole FROM t)
SELECT id, CASE WHEN whole THEN 1 ELSE segment END::BIGINT AS segment FROM s WHERE whole OR segment >= 1"""
)
def skill_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each task; a session without user turns is one task."""
    return skills.segments(messages(spark, sf_dir), repaired_turns(spark, sf_dir), KEYS).select("id", "segment")


@register(
    rf"""WITH {MESSAGES_SQL}, {ROLLUP_SQL}, b AS (SELECT *, trim(text, E' \n\t\r') AS body FROM m WHERE role IN ('user', 'assistant')),
n AS (SELECT tool, session_id, id, role, CASE WHEN length(body) > 2000 THEN substr(body, 1, 1999) || '…' ELSE body END AS said FROM b WHERE body <> ''),
l AS (SELECT tool, session_id, coalesce(arg_max(said, id) FILTER (role = 'user'), '') AS u, coalesce(arg_max(said, id) FILTER (role = 'assistant'), '') AS a FROM n GROUP BY ALL),
r AS (SELECT * FROM roll WHERE tool = 'codex' ORDER BY updated DESC, tool, session_id, source_path LIMIT 25)
SELECT source_path, '{{"tool":' || to_json(tool) || ',"session_id":' || to_json(session_id) || ',"title":' || to_json(title) || ',"updated":' || to_json({TIME_SQL.format('updated')}) || ',"message_count":' || n_messages || ',"source_path":' || to_json(source_path)
  || CASE WHEN coalesce(u, '') <> '' THEN ',"last_user":' || to_json(u) ELSE '' END || CASE WHEN coalesce(a, '') <> '' THEN ',"last_assistant":' || to_json(a) ELSE '' END || '}}' AS line
FROM r LEFT JOIN l USING (tool, session_id)"""
)
def recent_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions last updated with their last rounds, as JSON lines with a fixed order of fields."""
    rows = sessions.recent_with_rounds(messages(spark, sf_dir), tool="codex", limit=25)
    fields = ["tool", "session_id", "title", "updated", ("message_count", "n_messages"), "source_path", "last_user", "last_assistant"]
    named = {f if isinstance(f, str) else f[0]: F.col(f if isinstance(f, str) else f[1]) for f in fields}
    return rows.select("source_path", json_line(named, ["last_user", "last_assistant"]).alias("line"))
