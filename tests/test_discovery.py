import json

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import decisions, skills
from threadlens.operators.search import Near, Not, Term, search_enriched
from threadlens.sources import discovery, jsonl

from .test_reference import made

KEYS = ["tool", "session_id"]


def test_sources_of_all_tools(spark, tmp_path):
    line = lambda **v: json.dumps(v) + "\n"
    files = {
        ".grok/sessions/%2Fw/s1/chat_history.jsonl": line(type="user", content="hello grok"),
        ".grok/sessions/%2Fw/s1/summary.json": json.dumps({"generated_title": "T", "info": {"cwd": "/there"}, "created_at": "2024-01-01T00:00:00Z"}),
        ".codex/sessions/2024/a.jsonl": line(type="session_meta", payload={"id": "c1", "cwd": "/c"}) + line(type="response_item", payload={"type": "message", "role": "user", "content": "hello codex"}),
        ".kimi-code/sessions/x/session_k/agents/a/wire.jsonl": line(type="context.append_message", message={"role": "user", "content": "hello kimi", "origin": {"kind": "user"}}),
        ".kimi-code/sessions/x/other/agents/a/wire.jsonl": "{}\n",
        ".claude/projects/p/q.jsonl": line(type="assistant", sessionId="d1", message={"role": "assistant", "content": [{"type": "text", "text": "hello claude"}]}),
        ".claude/projects/p/deeper/q.jsonl": "{}\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = discovery.sources(spark, str(tmp_path))
    rows = {r.tool: r for r in found.collect()}
    assert sorted(rows) == ["claude", "codex", "grok", "kimi-code"] and found.count() == 4
    assert rows["grok"].size == len(files[".grok/sessions/%2Fw/s1/chat_history.jsonl"]) + len(files[".grok/sessions/%2Fw/s1/summary.json"])
    said = {r.tool: r for r in discovery.read_all(spark, found).collect()}
    assert {t: r.text for t, r in said.items()} == {"claude": "hello claude", "codex": "hello codex", "grok": "hello grok", "kimi-code": "hello kimi"}
    assert said["grok"].cwd == "/there" and said["grok"].title == "T" and said["codex"].cwd == "/c"
    with pytest.raises(ValueError):
        discovery.read_all(spark, found.limit(0))


def test_search_without_positive_terms(spark):
    talk = made(spark, [("one", "user", "alpha starts"), ("two", "user", "beta ends " * 50), ("two", "assistant", "gamma beta")])
    assert {r.session_id for r in search_enriched(talk, Not(Term("alpha"))).collect()} == {"two"}
    got = search_enriched(talk, Near(Term("gamma"), Term("ends"))).collect()
    assert got[0].message_count == 2 and got[0].snippets.startswith("beta ends") and got[0].snippets.endswith("gamma beta")
    assert search_enriched(talk, None).count() == 2


def test_marks_and_times(spark):
    row = spark.range(1).select(
        T.highlight(F.lit("A$b ab ABC"), ["ab", "abc", "a$B"], "<$", "\\>").alias("h"), T.highlight(F.lit("x"), [], "<", ">").alias("n"),
        *[T.relative_time(F.lit(t).cast("double"), F.lit(1e6)).alias(f"t{i}") for i, t in enumerate([1e6 - 59, 1e6 - 60, 1e6 + 7200, 1e6 - 86400 * 31, None])],
    ).first()
    assert (row.h, row.n) == ("<$A$b\\> <$ab\\> <$ABC\\>", "x")
    assert [row[f"t{i}"] for i in range(5)] == ["just now", "1m ago", "in 2h", "1mo ago", "-"]


def test_merged_decisions(spark):
    lines = [("s", "user", "We choose SQLite over Postgres because it is simple."), ("s", "assistant", "I recommend SQLite. We choose SQLite over MySQL because it is small."), ("s", "user", "Let's use Redis because it is fast.")]
    found = decisions.candidates(made(spark, lines), KEYS)
    rows = {r.chosen: r for r in decisions.merged(found, KEYS).collect()}
    assert sorted(rows) == ["Redis", "SQLite"]
    one = rows["SQLite"]
    assert (one.message_start, one.message_end, one.options, one.rationale) == (1, 2, ["SQLite", "Postgres", "MySQL"], "it is simple") and len(one.members) >= 2
    assert decisions.merged(found.limit(0), KEYS).count() == 0


def test_pending_absorbs_longer_ids(spark):
    talk = made(spark, [("ab", "user", "Fix the parser"), ("ABc", "assistant", "Done, all tests passed"), ("x", "system", "nothing")])
    from threadlens.operators.sessions import session_rollup

    none = spark.createDataFrame([], "tool string, session_id string")
    got = {r.session_id: r for r in skills.extract_pending(talk, session_rollup(talk), none, spark.createDataFrame([("fix-the-parser",)], "slug string"), KEYS).collect()}
    assert got["x"].status == "failed" and got["x"].slug == "empty-session-x" and got["ab"].slug == "fix-the-parser-2"
    assert got["ab"].status == "draft" or got["ab"].score == 0.0
    assert sorted(got) == ["ABc", "ab", "x"]


def test_many_files_of_a_folder(spark, tmp_path):
    """Of folders that hold many of the files asked for, just these are read, each once, also where one folder is in another."""
    asked = []
    for k in range(24):
        folder = tmp_path / "p+q 1%20" / ("in/ner" if k % 3 == 0 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"s{k}.jsonl").write_text(json.dumps({"type": "user", "sessionId": f"s{k}", "message": {"content": f"text {k}"}}) + "\n")
        asked += [f"file:{folder}/s{k}.jsonl"] if k % 2 == 0 else []
    assert sorted(r.text for r in jsonl.read_claude(spark, asked).collect()) == sorted(f"text {k}" for k in range(0, 24, 2))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a partition for each file that is read
    try:
        opened = jsonl._opened(spark, asked)
        assert len(opened.inputFiles()) == 24 and opened.rdd.getNumPartitions() == 12
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
