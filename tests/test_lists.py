"""Orders, lists and small writers that no query shows."""

from pyspark.sql import functions as F

from threadlens.operators import candidates, decisions, incremental, skills
from threadlens.sinks import results
from threadlens.streaming.refresh import session_activity


def test_orders_and_lists(spark):
    d = spark.createDataFrame([("s", 2, "a"), ("s", 1, "b"), ("r", 9, "c"), ("s", 1, "a")], "session_id string, at int, decision_id string")
    assert [(r.session_id, r.at, r.decision_id) for r in decisions.in_order(d).collect()] == [("r", 9, "c"), ("s", 1, "a"), ("s", 1, "b"), ("s", 2, "a")]
    e = spark.createDataFrame([("t", "s", 3, "e1"), ("t", "s", 1, "e2"), ("t", "s", 1, "e1")], "tool string, session_id string, message_index int, evidence_id string")
    assert [(r.message_index, r.evidence_id) for r in skills.evidence_in_order(e, ["tool", "session_id"]).collect()] == [(1, "e1"), (1, "e2"), (3, "e1")]
    events = spark.createDataFrame([("c", "2", "x", "y"), ("c", "1", "z", "x"), ("d", "0", "", "")], "candidate_id string, timestamp string, before_hash string, after_hash string")
    assert [r.timestamp for r in candidates.list_events(events, "c").collect()] == ["1", "2"] and candidates.list_events(events, "none").count() == 0
    assert len(candidates.statuses()) == 10 and candidates.statuses() == sorted(candidates.statuses())


def test_upsert_and_payloads(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    got = incremental.upsert(now, spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string"), ["k"])
    assert sorted((r.k or 0, r.v) for r in got.collect()) == [(0, "n"), (1, "a"), (2, "B"), (3, "C")]
    b = spark.createDataFrame([("slug", ["x", 'y"'], 0.5), (None, [], None)], "slug string, lines array<string>, score double")
    back = skills.from_payload(skills.payload(b, ["slug", "lines", "score"]), "slug string, lines array<string>, score double").collect()
    assert [(r.bundle.slug, r.bundle.lines, r.bundle.score) for r in back] == [("slug", ["x", 'y"'], 0.5), (None, [], None)]
    assert skills.from_payload(spark.createDataFrame([("no JSON",)], "payload string"), "slug string").first().bundle.slug is None


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("<a>", "", 3), (None, 'q"', None)], "t string, last string, n int")
    lines = rows.select(results.json_line({"n": F.col("n"), "t": F.col("t"), "last": F.col("last")}, ["last"]).alias("value"))
    assert [r.value for r in lines.collect()] == ['{"n":3,"t":"<a>"}', '{"last":"q\\""}']
    results.write_lines(lines.coalesce(1), f"file://{tmp_path}/lines")
    assert spark.read.text(f"file://{tmp_path}/lines").count() == 2


def test_sessions_of_events(spark):
    e = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2024-01-01 00:00:00'), (1L, TIMESTAMP '2024-01-01 00:20:00'), (1L, TIMESTAMP '2024-01-01 02:00:00'), (2L, TIMESTAMP '2024-01-01 00:00:00') AS t(user_id, ts)")
    assert sorted((r.user_id, r.n) for r in session_activity(e).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_skills_text_is_parsed_once(spark):
    """The lines of a document stand in the plan once, however many faults are looked for in them."""
    d = spark.range(3).selectExpr("concat('---\nname: a\ndescription: ', id, '\n---\nbody') AS text", "'a' AS expected")
    read = d.select(skills.parse_markdown(F.col("text"), F.col("expected")).alias("p")).select("p.*")
    assert [tuple(r) for r in read.collect()] == [("a", str(i), None) for i in range(3)]
    assert read._jdf.queryExecution().analyzed().toString().count("split(") == 1
