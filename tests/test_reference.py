import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadlens.functions import regexes as R
from threadlens.functions import text as T
from threadlens.functions.timestamps import format_timestamp, timestamp_epoch
from threadlens.operators import candidates, incremental, requests, signals
from threadlens.operators.search import Near, Not, Phrase, Term, positive_terms, search
from threadlens.sources.jsonl import read_claude, read_codex, read_grok, read_kimi
from threadlens.sources.opencode import read_opencode
from threadlens.streaming.refresh import read_table, rebuild, refresh, vacuum

MESSAGE = "id long, tool string, session_id string, source_path string, cwd string, ts double, role string, text string"


def made(spark, rows):
    return spark.createDataFrame([(i, "codex", s, f"/src/{s}", "/work", float(i), role, text) for i, (s, role, text) in enumerate(rows)], MESSAGE)


@pytest.fixture(scope="module")
def talk(spark):
    return made(spark, [("one", "user", "alpha starts"), ("one", "assistant", "then beta"), ("two", "user", "Alpha beta gamma"), ("two", "assistant", "forbidden thing"), ("three", "user", "quay only"), ("three", "assistant", "a lantern"), ("four", "user", "部署完成 ✅ café")])


def found(df):
    return {r.session_id for r in df.collect()}


@pytest.mark.parametrize(
    "condition, expected",
    [
        (Near(Term("alpha"), Term("beta")), {"one", "two"}),
        (Term("alpha") & Term("beta"), {"two"}),
        (Near(Term("alpha"), Not(Term("beta"))), {"one"}),
        (Phrase("alpha beta"), {"two"}),
        (Term("quay-lantern"), {"three"}),
        (Term("✅"), {"four"}),
        (Term("部"), {"four"}),
        (Term("cafe"), {"four"}),
        (Term("alpha") | Term("lantern"), {"one", "two", "three"}),
    ],
)
def test_search(talk, condition, expected):
    assert found(search(talk, condition)) == expected


def test_search_limit_and_terms(talk):
    with pytest.raises(ValueError):
        search(talk, Term("alpha"), limit=0)
    assert positive_terms(Near(Term("ab"), Near(Phrase("abc d"), Not(Term("zzzzzzz"))))) == ["abc d", "ab"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.slugify(lit("  Hello, Wörld! 2 "))) == "hello-wrld-2"
    assert one(spark, T.display_width(lit("ab部署é"))) == 7
    assert one(spark, T.plain_field(lit("\x1b[31mred\x1b[0m \t x\x07"))) == "red x"
    assert one(spark, T.redact(lit("mail a.b@c.org token = 'x' /home/me/f"))) == "mail [REDACTED_EMAIL] [REDACTED_SECRET] [REDACTED_PATH]"
    for n in range(12286, 12292):
        for tail in ("a", "é", "部", "😀"):
            text = "x" * (n - 40) + tail * 40
            cut = one(spark, T.truncate_bytes(lit(text)))
            raw = text.encode()
            expected = text if len(raw) <= 12288 else raw[: 12288 - 14].decode(errors="ignore") + "…[truncated]"
            assert cut == expected
    assert one(spark, T.snippet(lit("x " * 300 + "Needle" + " y" * 300), "needle")).count("Needle") == 1


def test_patterns_compile(spark):
    for name, value in vars(R).items():
        if isinstance(value, str) and name.isupper():
            assert one(spark, F.lit("some text\n").rlike(R.java(value))) in (True, False)
    assert not one(spark, T.matches(F.lit("übuse"), r"\bbuse\b")) is None


@pytest.mark.parametrize("raw, epoch", [("1700000000", 1700000000.0), ("1700000000000", 1700000000.0), ("2024-01-01", 1704067200.0), ("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T01:00:00+01:00", 1704067200.0), ("no", None)])
def test_timestamps(spark, raw, epoch):
    assert one(spark, timestamp_epoch(F.lit(raw))) == epoch
    assert one(spark, format_timestamp(F.lit(0.9999999))) == "1970-01-01T00:00:01Z"


def test_signals(spark):
    m = made(spark, [("good", "user", "please"), ("good", "assistant", "go test ./... ok passed"), ("good", "user", "perfect, thanks"), ("bad", "assistant", "here"), ("bad", "user", "no, that is wrong"), ("leak", "user", "token = abc")])
    rows = {r.session_id: r for r in signals.quality_gate(signals.signal_bundle(m, ["tool", "session_id"])).collect()}
    assert (rows["good"].action, rows["good"].success_evidence, rows["good"].disposition) == ("draft", "acceptance|tests_passed", "draft")
    assert (rows["bad"].intent, rows["bad"].action) == ("correction", "review")
    assert (rows["leak"].secret_risk, rows["leak"].action) == (0.75, "suppress")


def test_candidates_and_changes(spark):
    log = spark.createDataFrame([(1, 1, "detected"), (1, 2, "draft"), (2, 1, "deleted")], "id long, version long, status string")
    current = candidates.latest(log)
    asked = spark.createDataFrame([(1, "in_review", 2), (1, "published", 2), (1, "in_review", 1), (2, "draft", 1), (9, "draft", 1)], "id long, to_status string, version long")
    assert sorted(r.outcome for r in requests.transition(current, asked).collect()) == ["conflict", "done", "invalid", "invalid", "missing"]
    assert requests.answered(current, asked.limit(1)).first().version == 3
    a = spark.createDataFrame([("x", 1), ("y", 2), ("n", None)], "k string, m int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("z", 1)], "k string, m int")
    assert {(r.k, r.change) for r in incremental.changes(a, b, "k", ["m"]).collect()} == {("x", "same"), ("y", "changed"), ("z", "removed"), ("n", "added")}


def test_readers(spark, tmp_path):
    codex = tmp_path / "rollout-12345678-1234-1234-1234-123456789abc.jsonl"
    codex.write_text("\n".join(json.dumps(x) for x in [{"type": "session_meta", "payload": {"id": "s1", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "hi"}, {"text": "there"}]}}]) + "\n{broken")
    r = read_codex(spark, str(codex)).collect()
    assert [(x.session_id, x.cwd, x.role, x.text, x.ts) for x in r] == [("s1", "/w", "user", "hi\nthere", 1704067200.0)]
    claude = tmp_path / "c.jsonl"
    claude.write_text(json.dumps({"type": "assistant", "sessionId": "s2", "cwd": "/c", "message": {"role": "assistant", "content": "ok"}}) + "\n" + json.dumps({"type": "summary"}))
    assert [(x.session_id, x.role, x.text) for x in read_claude(spark, str(claude)).collect()] == [("s2", "assistant", "ok")]
    grok = tmp_path / "%2Fhome%2Fa+b" / "s3"
    grok.mkdir(parents=True)
    (grok / "chat_history.jsonl").write_text(json.dumps({"type": "user", "content": [{"text": "q"}]}))
    assert [(x.session_id, x.text) for x in read_grok(spark, str(grok / "chat_history.jsonl")).collect()] == [("s3", "q")]
    kimi = tmp_path / "session_k" / "agents" / "main"
    kimi.mkdir(parents=True)
    (kimi / "wire.jsonl").write_text("\n".join(json.dumps(x) for x in [{"type": "context.append_message", "time": 1700000000000, "message": {"role": "user", "origin": {"kind": "user"}, "content": "go"}}, {"type": "context.append_loop_event", "time": 1, "event": {"type": "tool.call", "name": "ls", "args": {"b": "<", "a": 1}}}]))
    got = sorted(read_kimi(spark, str(kimi / "wire.jsonl")).collect(), key=lambda x: x.line)
    assert [(x.session_id, x.role, x.text) for x in got] == [("session_k", "user", "go"), ("session_k", "assistant", 'tool.call ls {"a":1,"b":"\\u003c"}')]
    db = tmp_path / "opencode.db"
    con = sqlite3.connect(db)
    con.executescript("CREATE TABLE session(id TEXT, directory TEXT, title TEXT, time_updated INTEGER); CREATE TABLE message(id TEXT, session_id TEXT, time_created INTEGER, data TEXT); CREATE TABLE part(id TEXT, message_id TEXT, time_created INTEGER, data TEXT); INSERT INTO session VALUES ('s','/d','t',1); INSERT INTO message VALUES ('m','s',NULL,'{\"role\":\"user\"}'); INSERT INTO part VALUES ('p2','m',2,'{\"text\":\"b\"}'),('p1','m',1,'{\"text\":\"a\"}')")
    con.commit()
    con.close()
    assert [(x.text, x.ts, x.title) for x in read_opencode(spark, [str(db)]).collect()] == [("a\nb", 1.0, "t")]


def test_refresh_is_idempotent(spark, tmp_path):
    inbox, target, point = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    schema = "source_path string, text string"
    for batch in ([("a", "1"), ("b", "1")], [("a", "2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inbox)
        for _ in range(2):
            refresh(spark, inbox, schema, target, point)
    assert {(r.source_path, r.text) for r in read_table(spark, target).collect()} == {("a", "2"), ("b", "1")}
    assert vacuum(spark, target) == 1 and vacuum(spark, target) == 0
    assert {(r.source_path, r.text) for r in read_table(spark, target).collect()} == {("a", "2"), ("b", "1")}
    rebuild(spark.createDataFrame([("c", "1")], schema), target)
    spark.createDataFrame([("d", "1"), (None, "1")], schema).coalesce(1).write.mode("append").parquet(inbox)
    refresh(spark, inbox, schema, target, point)
    assert {(r.source_path, r.text) for r in read_table(spark, target).collect()} == {("c", "1"), ("d", "1"), (None, "1")}
    with pytest.raises(Exception, match="buckets"):
        spark.createDataFrame([("d", "2")], schema).coalesce(1).write.mode("append").parquet(inbox)
        refresh(spark, inbox, schema, target, point, buckets=7)


def test_long_files_are_read_in_order_by_several_tasks(spark, tmp_path):
    rows = [{"type": "session_meta", "payload": {"id": f"s{i // 50}"}} if i % 50 == 0 else {"type": "response_item", "payload": {"type": "message", "role": "user", "content": f"m{i}"}} for i in range(2000)]
    (tmp_path / "long.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "short.jsonl").write_text(json.dumps(rows[0]) + "\n\n" + json.dumps(rows[1]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_codex(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = sorted((r for r in got if r.source_path.endswith("long.jsonl")), key=lambda r: r.line)
    assert [(r.session_id, r.text) for r in long] == [(f"s{i // 50}", f"m{i}") for i in range(2000) if i % 50]
    assert [(r.session_id, r.text) for r in got if r.source_path.endswith("short.jsonl")] == [("s0", "m1")]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
