"""The queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions import regexes as R
from ..functions import text as T
from ..functions.timestamps import format_timestamp, timestamp_epoch
from ..operators import candidates, commits, decisions, incremental, postings, requests, sessions, signals, skills, windows
from ..operators.search import And, Near, Not, Or, Phrase, Term, matching_messages, search, search_enriched
from ..sources.jsonl import content_text
from ..streaming.refresh import read_table
from .registry import KEYS, ORACLES, QUERIES, register
from .search_sql import ROLLUP_SQL, TIME_SQL, TOKENS_SQL, condition_sql, quoted, search_sql
from .tables import MESSAGES_SQL, TOOLS, messages, shared_folder, table

# Searches -------------------------------------------------------------------------------------------------------------------------

SEARCHES: dict[str, tuple] = {
    "search_term": (Term("thatble"), {}),
    "search_phrase": (Phrase("in the"), {}),
    "search_implicit_and": (Near(Term("thatble"), Term("onthe")), {}),
    "search_explicit_and": (And(Term("the"), Term("ing")), {}),
    "search_or": (Or(Term("thatble"), Term("leon")), {}),
    "search_not": (Near(Term("the"), Not(Term("ing"))), {}),
    "search_grouped": (And(Or(Term("the"), Term("los")), Not(Or(Term("ing"), Term("ción")))), {}),
    "search_punct_tokens": (Term("on-the"), {}),
    "search_accent_folding": (Phrase("etre"), {}),
    "search_double_not": (Not(Not(Term("und"))), {}),
    "search_field_tool": (Term("the"), {"tools": ["codex"]}),
    "search_field_cwd": (Term("the"), {"cwds": ["/WORK/P3"]}),
    "search_two_tools": (Term("the"), {"tools": ["codex", "grok"]}),
    "search_after": (Term("the"), {"after": 1704067200.0 + 600 * 50}),
    "search_filter_only": (None, {"tools": ["claude"]}),
    "search_include_system": (Term("the"), {"include_system": True}),
    "search_topk_rank": (Or(Or(Term("the"), Term("and")), Term("ing")), {"limit": 7}),
}


def _search_query(name: str) -> None:
    condition, filters = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(messages(spark, sf_dir), condition, **filters)

    QUERIES[name], ORACLES[name] = run, search_sql(condition, **filters)


for _name in SEARCHES:
    _search_query(_name)


# The same searches by postings, which are built for them first: what a search finds does not change.
def _indexed_query(name: str) -> None:
    condition, filters = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = shared_folder(spark, "postings")
        postings.build(messages(spark, sf_dir), target, sessions=300)
        return postings.indexed_search(spark, messages(spark, sf_dir), target, condition, **filters)

    QUERIES[f"indexed_{name}"], ORACLES[f"indexed_{name}"] = run, search_sql(condition, **filters)


for _name in ("search_term", "search_phrase", "search_implicit_and", "search_grouped", "search_accent_folding", "search_punct_tokens"):
    _indexed_query(_name)


def _holds_sql(value: str) -> str:
    """Whether a session has all runs of three characters of a value, as it stands or as words."""
    ways = [(postings._grams_of(value.lower()), "lower(text)"), (postings._grams_of(T.token_text_of(value)), "tok")]
    return "(" + " OR ".join("(" + " AND ".join(f"(bool_or(contains(lower(text), {quoted(g)})) OR bool_or(contains(tok, {quoted(g)})))" for g in gs) + ")" for gs, _ in ways) + ")"


@register(
    f"""WITH {MESSAGES_SQL}, u AS (SELECT *, {TOKENS_SQL} AS tok FROM m), s AS (SELECT tool, session_id, count(*) AS n, {_holds_sql('thatble')} AND {_holds_sql('onthe')} AS may FROM u GROUP BY tool, session_id)
SELECT tool, session_id, n AS texts_read FROM s WHERE may"""
)
def indexed_texts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions whose texts a search by postings reads, and how many these are."""
    target = shared_folder(spark, "postings")
    m = messages(spark, sf_dir)
    postings.build(m, target, sessions=300)
    read = postings.narrowed(m, read_table(spark, target), SEARCHES["search_implicit_and"][0])
    return read.groupBy(*KEYS).agg(F.count("*").alias("texts_read"))

_TERM = Or(Term("thatble"), Term("leon"))


@register(
    f"""WITH {MESSAGES_SQL}, u AS (SELECT *, {TOKENS_SQL} AS tok FROM m WHERE role IN ('user', 'assistant'))
SELECT id, tool, session_id FROM u WHERE {condition_sql(_TERM)}"""
)
def matching_message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_messages(messages(spark, sf_dir), _TERM)[0].select("id", "tool", "session_id")


@register()
def search_snippets_and_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_enriched(messages(spark, sf_dir), _TERM)


# Sessions -------------------------------------------------------------------------------------------------------------------------


@register(f"WITH {MESSAGES_SQL}, {ROLLUP_SQL} SELECT * FROM roll")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_rollup(messages(spark, sf_dir))


@register(
    f"""WITH {MESSAGES_SQL}, t AS (SELECT unnest([{', '.join(map(quoted, TOOLS))}]) AS tool)
SELECT t.tool, count(DISTINCT session_id) AS sessions, count(id) AS messages FROM t LEFT JOIN m USING (tool) GROUP BY t.tool"""
)
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.tool_stats(messages(spark, sf_dir))


@register(f"WITH {MESSAGES_SQL} SELECT tool, session_id, id, {TIME_SQL.format('ts')} AS time, role, text FROM m WHERE starts_with(session_id, 'conv-00001') AND role = 'user'")
def show_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.show(messages(spark, sf_dir), "CONV-00001", role="user")


@register(
    f"""WITH {MESSAGES_SQL}, {ROLLUP_SQL} SELECT tool, session_id, source_path, title, {TIME_SQL.format('updated')} AS updated, n_messages
FROM roll WHERE updated >= 1704070000 ORDER BY roll.updated DESC, tool, session_id, source_path LIMIT 100"""
)
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent(messages(spark, sf_dir), after=1704070000.0)


@register(
    rf"""WITH {MESSAGES_SQL}, b AS (SELECT *, trim(text, E' \n\t\r') AS body FROM m WHERE role IN ('user', 'assistant')),
n AS (SELECT *, CASE WHEN length(body) > 2000 THEN substr(body, 1, 1999) || '…' ELSE body END AS said FROM b WHERE body <> '')
SELECT tool, session_id, coalesce(arg_max(said, id) FILTER (role = 'user'), '') AS last_user, coalesce(arg_max(said, id) FILTER (role = 'assistant'), '') AS last_assistant FROM n GROUP BY ALL"""
)
def last_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_rounds(messages(spark, sf_dir))


@register(f"WITH {MESSAGES_SQL} SELECT tool, session_id, count(*) AS message_count FROM m GROUP BY ALL")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("message_count"))


# Scalars --------------------------------------------------------------------------------------------------------------------------


@register("SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'assistant') THEN lower(role) ELSE 'system' END AS role FROM conversations")
def normalize_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_role(F.col("role"), F.col("text")).alias("role"))


@register(r"SELECT conv_id, turn, substr(trim(regexp_replace(split_part(trim(text, E' \n\t\r'), E'\n', 1), '\s+', ' ', 'g')), 1, 120) AS title FROM conversations")
def title_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.title_from_text(F.col("text")).alias("title"))


# 12288 bytes less 14 of the mark are kept, but no half of a character: the longest prefix of whole characters with at most that many bytes.
@register(
    """WITH c AS (SELECT doc_id, text, CASE WHEN strlen(text) > 12288 THEN list_filter(range(9200, 12275), lambda n: strlen(substr(text, 1, n::INT)) <= 12274)[-1] END AS n FROM documents)
SELECT doc_id, n IS NOT NULL AS was_cut, md5(CASE WHEN n IS NULL THEN text ELSE substr(text, 1, n::INT) || '…[truncated]' END) AS cut_md5 FROM c"""
)
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.truncate_bytes(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", (cut != F.col("text")).alias("was_cut"), F.md5(cut).alias("cut_md5"))


@register("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN text WHEN turn % 4 = 3 THEN '' ELSE concat_ws(chr(10), nullif(text, ''), nullif(role, ''), nullif(text, '')) END AS content FROM conversations")
def content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as messages hold them: plain, in blocks four levels deep, and where they don't count."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text, role = (json_text.json_string(F.col(c)) for c in ("text", "role"))
    deep = say('{"content":[{"text":', text, '},7,[', text, '],{"content":{"content":[{"content":[', role, ']},{"text":5,"content":', text, "}]}}]}")
    flat = say("[", text, ',{"text":', role, '},{"content":', text, "},{}]")
    content = F.when(F.col("turn") % 4 == 0, text).when(F.col("turn") % 4 == 1, deep).when(F.col("turn") % 4 == 2, flat).otherwise(say('{"content":[[', text, "]]}"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_parse_json(say('{"c":', content, "}")).alias("v"))
    return rows.select("conv_id", "turn", content_text("c").alias("content"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM events")
def format_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", format_timestamp(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"))


@register("SELECT event_id, round(floor(epoch_us(ts) / 1000.0) / 1000, 3) AS epoch FROM events")
def timestamp_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return e.select("event_id", F.round(timestamp_epoch(text), 3).alias("epoch"))


_REDACT = "text"
for _p, _r in R.REDACTIONS:
    _REDACT = f"regexp_replace({_REDACT}, {quoted(_p)}, {quoted(_r)}, 'g')"


@register(f"SELECT doc_id, md5({_REDACT}) AS redacted_md5, {_REDACT} <> text AS was_changed FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("r"), "text").select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("was_changed"))


# JSON texts around the documents' texts, five levels deep; every fifth one is no JSON. Strings are redacted where they stand.
_STRING_SQL = quoted(json_text.STRING.replace("*+", "*"))
_REDACTED_LITERAL = "json_extract_string(l, '$')"
for _p, _r in R.REDACTIONS:
    _REDACTED_LITERAL = f"regexp_replace({_REDACTED_LITERAL}, {quoted(_p)}, {quoted(_r)}, 'g')"
_HTML = "to_json(r)::VARCHAR"
for _raw, _escaped in json_text.ESCAPED.items():
    _HTML = f"replace({_HTML}, '{_raw}', '{_escaped}')"


@register(
    f"""WITH j AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '{{"a":[{{"b":{{"K":[[' || to_json(text) || ',' || doc_id || '.50]],"me@example.com":null}}}}],"z":"token=abc ' || doc_id || '"}}' END AS json FROM documents),
parts AS (SELECT *, regexp_extract_all(json, {_STRING_SQL}) AS lits, string_split_regex(json, {_STRING_SQL}) AS gaps FROM j),
changed AS (SELECT *, list_transform(lits, lambda l: struct_pack(r := {_REDACTED_LITERAL})) AS done FROM parts WHERE doc_id % 5 <> 0),
woven AS (SELECT doc_id, list_reduce(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(done) THEN '' ELSE list_transform([done[i].r], lambda r: {_HTML})[1] END), lambda a, b: a || b) AS red FROM changed)
SELECT doc_id, md5(replace(red, doc_id || '.50]', doc_id || '.5]')) AS redacted_md5 FROM woven UNION ALL SELECT doc_id, md5({_REDACT.replace('text', 'json', 1)}) FROM j WHERE doc_id % 5 = 0"""
)
def redact_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.concat(F.lit('{"a":[{"b":{"K":[['), json_text.json_string(F.col("text"), html=False), F.lit(","), F.col("doc_id"), F.lit('.50]],"me@example.com":null}}],"z":"token=abc '), F.col("doc_id"), F.lit('"}'))
    json = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(inner)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(json_text.redact_json(json)).alias("redacted_md5"))


@register("SELECT doc_id, (" + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in R.SECRETS) + ")::BIGINT AS secrets FROM documents")
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.secret_count(F.col("text")).alias("secrets"))


# Every third document gets wide characters and combining marks, every third page escape sequences; what they add and hide is known.
@register("SELECT doc_id, length(text)::BIGINT + CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 0 END AS width FROM documents")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("部署é́"), "text", F.lit("ｗ한"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.display_width(text).cast("long").alias("width"))


@register(r"SELECT page_id, md5(trim(regexp_replace(CASE WHEN page_id % 3 = 0 THEN 'red ' ELSE '' END || html || CASE WHEN page_id % 3 = 0 THEN ' end' ELSE '' END, '\s+', ' ', 'g'))) AS plain_md5 FROM pages")
def plain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("\x1b[1;31mred\x1b[0m\t\x07"), "html", F.lit("\x1b]0;title\x07 \x1bMe\x00nd\x7f"))
    text = F.when(F.col("page_id") % 3 == 0, marked).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.plain_field(text)).alias("plain_md5"))


_STRIP = "text"
for _p in (R.FENCED_CODE, R.INLINE_CODE, R.MARKDOWN_LINK, R.MARKDOWN_MARKER):
    _STRIP = f"regexp_replace({_STRIP}, {quoted(_p)}, ' ', 'g')"


@register(rf"SELECT doc_id, md5(trim(regexp_replace({_STRIP}, '\*\*|__|~~', ' ', 'g'), E' \n\t\r')) AS stripped_md5 FROM documents")
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("stripped_md5"))


@register(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


# Every second page has a UUID in its id.
@register("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN printf('%08x', page_id) ELSE substr(url, 1, 12) END AS short_id FROM pages")
def short_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    uuid = F.format_string("%08x-0000-4000-8000-0123456789ab", "page_id")
    return table(spark, sf_dir, "pages").select("page_id", T.short_id(F.when(F.col("page_id") % 2 == 0, uuid).otherwise(F.col("url"))).alias("short_id"))


@register(r"SELECT conv_id, turn, CASE WHEN length(s) > 240 THEN substr(s, 1, 239) || '…' ELSE s END AS summary FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations)")
def message_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.message_summary(F.col("text")).alias("summary"))


# Signals --------------------------------------------------------------------------------------------------------------------------

_SIGNAL_SQL = f"""WITH {MESSAGES_SQL},
s AS (SELECT *, lag(role) OVER (PARTITION BY tool, session_id ORDER BY ts, id) AS before FROM m WHERE role IN ('user', 'assistant') AND trim(text, E' \\n\\t\\r') <> ''),
f AS (SELECT *, before = 'assistant' AND role = 'user' AS answered, regexp_matches(text, {quoted(R.CORRECTION)}) AS correction, regexp_matches(text, {quoted(R.TEST_PASSED)}) AS passed,
  regexp_matches(text, {quoted(R.TEST_FAILED)}) AS failed, lower(text) AS low FROM s),
c AS (SELECT tool, session_id, count(*) AS n,
  count(*) FILTER (answered AND correction) AS corrections, count(*) FILTER (answered AND NOT correction AND regexp_matches(text, {quoted(R.ACCEPTANCE)})) AS acceptances,
  count(*) FILTER (regexp_matches(text, {quoted(R.DECISION)})) AS decisions, count(*) FILTER (regexp_matches(text, {quoted(R.QUESTION)})) AS questions,
  count(*) FILTER (regexp_matches(text, {quoted(R.WORKFLOW)})) AS workflows,
  count(*) FILTER (contains(low, '```') OR contains(low, 'func ') OR contains(low, 'class ') OR contains(low, 'implement') OR contains(low, '实现') OR contains(low, '代码')) AS implementations,
  count(*) FILTER (passed AND NOT failed) AS passes, count(*) FILTER (failed) AS failures, count(*) FILTER (regexp_matches(text, {quoted(R.ONE_OFF)})) AS one_offs,
  sum({' + '.join(f'len(regexp_extract_all(text, {quoted(p)}))' for p in R.SECRETS)})::BIGINT AS secrets FROM f GROUP BY ALL)"""
_BUNDLE_SQL = f"""{_SIGNAL_SQL},
i AS (SELECT *, CASE WHEN corrections > 0 AND corrections >= acceptances THEN 'correction' WHEN acceptances > corrections AND passes > 0 THEN 'acceptance' WHEN decisions > 0 THEN 'decision'
  WHEN workflows > 0 THEN 'workflow' WHEN implementations > 0 THEN 'implementation' WHEN questions > 0 THEN 'question' WHEN acceptances > 0 THEN 'acceptance' WHEN failures > 0 THEN 'correction' ELSE 'unknown' END AS intent,
  least(1.0::DOUBLE, secrets * 0.75::DOUBLE) AS secret_risk, acceptances + passes * 0.9::DOUBLE AS positive, corrections * 1.25::DOUBLE + failures AS negative FROM c),
k AS (SELECT *, least(1.0::DOUBLE, 0.34::DOUBLE + least(0.42::DOUBLE, (positive + negative) * 0.08::DOUBLE) + CASE WHEN intent <> 'unknown' THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN n >= 3 THEN 0.06 ELSE 0 END::DOUBLE + least(0.1::DOUBLE, secret_risk * 0.1::DOUBLE)) AS confidence,
  CASE WHEN one_offs > 0 THEN 0.95::DOUBLE ELSE greatest(0.0::DOUBLE, 0.58::DOUBLE + CASE WHEN n <= 2 THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN workflows > 0 THEN 0.35 ELSE 0 END::DOUBLE - CASE WHEN acceptances > 0 THEN 0.12 ELSE 0 END::DOUBLE - CASE WHEN corrections > 0 THEN 0.04 ELSE 0 END::DOUBLE - CASE WHEN passes > 0 THEN 0.08 ELSE 0 END::DOUBLE) END AS one_off_risk FROM i),
b AS (SELECT tool, session_id, intent, round(confidence, 6) AS confidence, concat_ws('|', CASE WHEN acceptances > 0 THEN 'acceptance' END, CASE WHEN passes > 0 THEN 'tests_passed' END) AS success_evidence, round(one_off_risk, 6) AS one_off_risk, secret_risk,
  CASE WHEN secret_risk >= 0.75 OR one_off_risk >= 0.92 THEN 'suppress' WHEN negative > positive + 0.35 OR failures > passes OR intent = 'correction' OR confidence < 0.45 THEN 'review'
    WHEN positive > 0 OR passes > 0 OR intent IN ('workflow', 'decision') THEN 'draft' ELSE 'review' END AS action FROM k)"""


@register(f"{_SIGNAL_SQL} SELECT tool, session_id, n, corrections, acceptances, decisions, questions, workflows, implementations, passes, failures, one_offs, secrets FROM c")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signal_counts(messages(spark, sf_dir), KEYS)


@register(f"{_BUNDLE_SQL} SELECT * FROM b")
def signal_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signal_bundle(messages(spark, sf_dir), KEYS)


@register(
    f"""{_BUNDLE_SQL}, r AS (SELECT *, concat_ws('|', CASE WHEN success_evidence = '' THEN 'insufficient success evidence' END, CASE WHEN one_off_risk >= 0.8 THEN 'one-off risk is high' END, CASE WHEN secret_risk >= 0.75 THEN 'secret risk is high' END) AS reasons FROM b)
SELECT *, CASE WHEN reasons = '' THEN 'draft' ELSE 'suppress' END AS disposition, round(CASE WHEN reasons = '' THEN least(1.0::DOUBLE, confidence + CASE WHEN contains(success_evidence, '|') THEN 0.05 ELSE 0 END::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS score FROM r"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.quality_gate(signals.signal_bundle(messages(spark, sf_dir), KEYS))


# Windows --------------------------------------------------------------------------------------------------------------------------


@register(f"WITH {MESSAGES_SQL} SELECT id, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) - 1 AS turn_no FROM m WHERE role = 'user'")
def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.turn_index(messages(spark, sf_dir), KEYS).select("id", "turn_no")


@register(
    f"""WITH {MESSAGES_SQL}, n AS (SELECT tool, session_id, count(*) AS n FROM m WHERE role = 'user' GROUP BY ALL),
w AS (SELECT *, unnest(range(0, greatest(0, ceil((n - 3) / 2.0))::BIGINT + 1)) AS w FROM n)
SELECT tool, session_id, w AS "window", w * 2 AS first_turn, least(3, n - w * 2) AS turns FROM w"""
)
def turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.turn_windows(messages(spark, sf_dir), KEYS, size=3)


@register(f"WITH {MESSAGES_SQL} SELECT id, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY tool, session_id ORDER BY id) AS state FROM m")
def fill_forward_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("state", F.when(F.col("role") == "system", F.col("text")))
    return windows.fill_forward(m, KEYS, ["id"], ["state"]).select("id", "state")


@register(f"WITH {MESSAGES_SQL} SELECT id, greatest(0, least(least(length(text), 1200), 6000 - coalesce(sum(least(length(text), 1200)) OVER (PARTITION BY tool, session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS chars FROM m")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_budget(messages(spark, sf_dir), KEYS).select("id", "chars")


@register(
    f"""WITH {MESSAGES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY tool, session_id) AS n, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) AS i FROM m)
SELECT id, least(6000 // n + CASE WHEN i <= 6000 % n THEN 1 ELSE 0 END, length(text))::BIGINT AS chars FROM n"""
)
def fair_share_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fair_share(messages(spark, sf_dir), KEYS).select("id", "chars")


@register(
    f"""WITH {MESSAGES_SQL}, n AS (SELECT *, sum((role = 'user' AND regexp_matches(text, '^[A-M]'))::INT) OVER (PARTITION BY tool, session_id ORDER BY ts, id) AS segment FROM m)
SELECT id, segment::BIGINT AS segment FROM n WHERE segment >= 1"""
)
def task_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("is_new", (F.col("role") == "user") & F.col("text").rlike("^[A-M]"))
    return windows.split_at(m, KEYS, "is_new").select("id", "segment")


@register(
    rf"""WITH {MESSAGES_SQL}, a AS (SELECT tool, session_id, trim(text, E' \n\t\r') AS body, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) AS nth FROM m WHERE role = 'assistant' AND trim(text, E' \n\t\r') <> '')
SELECT tool, session_id, string_agg(CASE WHEN length(body) > 800 THEN substr(body, 1, 799) || '…' ELSE body END, E'\n\n' ORDER BY nth) AS instructions FROM a WHERE nth <= 3 GROUP BY ALL"""
)
def skill_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.instructions(messages(spark, sf_dir), KEYS)


# Incremental work and candidates --------------------------------------------------------------------------------------------------


def _order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of orders as sources: the earlier one lacks some, and some have another mark."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("mark"))
    old = o.where("o_orderkey % 7 <> 0").withColumn("mark", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("mark")))
    return o.where("o_orderkey % 11 <> 0"), old


_STATES_SQL = """now AS (SELECT o_orderkey, o_orderstatus AS mark FROM orders WHERE o_orderkey % 11 <> 0),
old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE o_orderstatus END AS mark FROM orders WHERE o_orderkey % 7 <> 0)"""


@register(
    f"""WITH {_STATES_SQL} SELECT coalesce(now.o_orderkey, old.o_orderkey) AS o_orderkey,
CASE WHEN old.o_orderkey IS NULL THEN 'added' WHEN now.o_orderkey IS NULL THEN 'removed' WHEN now.mark = old.mark THEN 'same' ELSE 'changed' END AS change FROM now FULL JOIN old ON now.o_orderkey = old.o_orderkey"""
)
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(*_order_states(spark, sf_dir), "o_orderkey", ["mark"])


@register(f"WITH {_STATES_SQL} SELECT * FROM now WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.o_orderkey = now.o_orderkey AND old.mark = now.mark)")
def sources_to_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.to_refresh(*_order_states(spark, sf_dir), "o_orderkey", ["mark"])


@register(f"WITH {_STATES_SQL} SELECT * FROM now UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM now)")
def replace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old = _order_states(spark, sf_dir)
    return incremental.replace_sources(old, now, "o_orderkey")


@register(
    f"""WITH {MESSAGES_SQL}, c AS (SELECT DISTINCT CASE WHEN id % 2000 < 1000 THEN '' ELSE tool END AS tool, session_id FROM m WHERE id % 3000 < 1000),
s AS (SELECT DISTINCT tool, session_id FROM m) SELECT tool, session_id FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = s.session_id AND (c.tool = '' OR c.tool = s.tool))"""
)
def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    queued = m.where("id % 3000 < 1000").select(F.when(F.col("id") % 2000 < 1000, "").otherwise(F.col("tool")).alias("tool"), "session_id")
    return incremental.pending_sessions(m.select(*KEYS).distinct(), queued).select(*KEYS)


def _candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidate versions: a user is a candidate, each event a version of it."""
    e = table(spark, sf_dir, "events")
    states = F.array(*map(F.lit, candidates.TRANSITIONS))
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.element_at(states, (F.col("event_id") % 10 + 1).cast("int")).alias("status"))


_LOG_SQL = f"""log AS (SELECT user_id AS id, event_id AS version, [{', '.join(map(quoted, candidates.TRANSITIONS))}][(event_id % 10 + 1)::INT] AS status FROM events),
latest AS (SELECT id, max(version) AS version, arg_max(status, version) AS status FROM log GROUP BY id)"""


@register(f"WITH {_LOG_SQL} SELECT * FROM latest")
def candidate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.latest(_candidate_log(spark, sf_dir))


_EDGES_SQL = "edges(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in candidates.TRANSITIONS.items() for b in to) + ")"


@register(
    f"""WITH {_LOG_SQL}, {_EDGES_SQL}, req AS (SELECT id, 'draft' AS to_status, version - (id % 3 = 0)::INT AS version FROM latest)
SELECT req.id, to_status, req.version, CASE WHEN latest.version <> req.version THEN 'conflict' WHEN EXISTS (SELECT 1 FROM edges WHERE a = status AND b = to_status) THEN 'done' ELSE 'invalid' END AS outcome FROM req JOIN latest ON latest.id = req.id"""
)
def candidate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = candidates.latest(_candidate_log(spark, sf_dir))
    asked = current.select("id", F.lit("draft").alias("to_status"), (F.col("version") - (F.col("id") % 3 == 0).cast("int")).alias("version"))
    return requests.transition(current, asked)


@register(f"WITH {_LOG_SQL} SELECT id, status, CASE WHEN id % 4 = 0 THEN id + 1 END AS replacement_id, id % 4 = 0 AS is_superseded FROM latest")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = candidates.latest(_candidate_log(spark, sf_dir))
    replaced = current.where("id % 4 = 0").select(F.col("id").alias("candidate_id"), (F.col("id") + 1).alias("replacement_id"))
    return candidates.superseded(current, replaced).select("id", "status", "replacement_id", "is_superseded")


# Decisions and skills --------------------------------------------------------------------------------------------------------------


# Messages of these tables hold no code, links or consequences, so splitting at sentence ends is the same there; tests cover the rest.
@register(
    rf"""WITH {MESSAGES_SQL}, s AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '[^\n\r.!?。！？;；]*[\n\r.!?。！？;；]?'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS parts FROM m WHERE role IN ('user', 'assistant'))
SELECT id, generate_subscripts(parts, 1)::INT - 1 AS ordinal, unnest(parts) AS segment FROM s"""
)
def decision_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.segments(messages(spark, sf_dir), KEYS).select("id", "ordinal", "segment")


@register(
    rf"""WITH {MESSAGES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY tool, session_id ORDER BY ts, id) AS pos FROM m),
e AS (SELECT id AS evidence_id, tool, session_id, CASE WHEN id % 2 = 0 THEN 'explicit' ELSE 'transcript' END AS kind, CASE WHEN id % 5 = 0 THEN substr(text, 3, 6) WHEN id % 7 = 0 THEN text || '~' ELSE substr(text, 3, 40) END AS quote, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN pos ELSE pos + 1 END AS pos FROM p),
l AS (SELECT *, length(trim(quote, E' 
	
')) >= 8 AS enough FROM e),
h AS (SELECT evidence_id, bool_or(p.role = 'user') AS by_user FROM l JOIN p ON p.tool = l.tool AND p.session_id = l.session_id AND (l.pos = 0 OR l.pos = p.pos) AND contains(p.text, quote) WHERE enough GROUP BY evidence_id)
SELECT evidence_id, CASE WHEN NOT enough THEN 'too_short' WHEN by_user IS NULL THEN 'not_found' WHEN kind = 'explicit' AND NOT by_user THEN 'wrong_role' ELSE 'ok' END AS outcome FROM l LEFT JOIN h USING (evidence_id)"""
)
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from all messages: some too short, some that nobody said, some pinned to the message after."""
    m = messages(spark, sf_dir)
    placed = windows.place(m, KEYS)
    quote = F.when(F.col("id") % 5 == 0, F.substring("text", 3, 6)).when(F.col("id") % 7 == 0, F.concat("text", F.lit("~"))).otherwise(F.substring("text", 3, 40))
    at = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("at")).otherwise(F.col("at") + 1)
    asked = placed.select(F.col("id").alias("evidence_id"), *KEYS, F.when(F.col("id") % 2 == 0, "explicit").otherwise("transcript").alias("kind"), quote.alias("quote"), at.alias("at"))
    return decisions.check_evidence(asked, m, KEYS)


@register(
    f"""WITH {MESSAGES_SQL} SELECT id, array_to_string(list(id) OVER (PARTITION BY tool, session_id ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '|') AS context FROM m"""
)
def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.context(messages(spark, sf_dir), KEYS).select("id", F.array_join(F.col("context").cast("array<string>"), "|").alias("context"))


@register(
    """WITH w AS (SELECT o_orderkey AS decision_id, 'p' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '/s' || (o_orderkey % 9) ELSE '' END AS path FROM orders),
c AS (SELECT 'h' || p_partkey AS hash, 'p' || p_partkey AS top, 'p' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/s' || (p_partkey % 9) || '/f.py' END AS path FROM part)
SELECT DISTINCT decision_id, hash FROM w JOIN c ON split_part(w.path, '/', 1) = c.top AND (w.path = c.path OR starts_with(c.path, w.path || '/') OR starts_with(w.path, c.path || '/'))"""
)
def commit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions on paths, parts as commits that touch paths."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    wanted = F.concat(F.lit("./p"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/s"), F.col("o_orderkey") % 9)).otherwise(""))
    touched = F.concat(F.lit("p"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("/s"), F.col("p_partkey") % 9, F.lit("/f.py"))))
    return commits.path_overlaps(o.select(F.col("o_orderkey").alias("decision_id"), wanted.alias("path")), p.select(F.concat(F.lit("h"), "p_partkey").alias("hash"), touched.alias("path")))


@register(
    """WITH r AS (SELECT p_partkey, 'part-of-' || (p_partkey % 97) || 'x' AS base, row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_partkey) AS nth FROM part)
SELECT p_partkey, CASE WHEN base = 'part-of-5x' THEN base || '-' || (nth + 1 + (nth >= 2)::INT) WHEN nth = 1 THEN base ELSE base || '-' || nth END AS slug FROM r"""
)
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share slugs; part-of-5x and part-of-5x-3 are taken already."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part-of-"), F.col("p_partkey") % 97, F.lit("x")).alias("slug"))
    return skills.unique_slugs(p, spark.createDataFrame([("part-of-5x",), ("part-of-5x-3",)], "slug string"), ["p_partkey"])


@register()
def skill_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skills.bundles(messages(spark, sf_dir), KEYS)
    return skills.markdown(skills.unique_slugs(found, spark.createDataFrame([], "slug string"), KEYS))


@register(
    f"""WITH {_LOG_SQL} SELECT id, CASE WHEN status IN ('approved', 'published') THEN 'accepted' WHEN status IN ('rejected', 'deferred') THEN status WHEN status IN ('draft', 'in_review') THEN 'draft' ELSE 'proposed' END AS state FROM latest"""
)
def decision_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.latest(_candidate_log(spark, sf_dir)).select("id", decisions.decision_state(F.col("status")).alias("state"))


# The rest registers itself.
from . import decision_queries, index_queries, session_queries, store_queries  # noqa: E402, F401
