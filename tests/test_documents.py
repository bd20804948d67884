"""Publishing documents as files: conflicts, repeated attempts, lost runs, and recording that fails."""

import hashlib

import pytest
from pyspark.sql import functions as F

from threadlens.operators import skills
from threadlens.operators.candidates import COLUMNS
from threadlens.sinks import documents as sink

from .test_reference import made

SCHEMA = "id string, slug string, document string"


def files(spark, root):
    return {r.slug: r.document for r in sink.read_documents(spark, root).collect()}


def outcomes(df):
    return sorted((r.id or "", r.outcome) for r in df.collect())


def test_conflicts_and_repeated_runs(spark, tmp_path):
    root = f"file://{tmp_path}/skills"
    rows = [("1", "one", "first"), ("2", "two", "second é"), ("10", "two", "too late"), ("3", "Not valid", "x"), ("4", "no-document", None), (None, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    first = sink.publish_documents(docs, root, "a")
    want = [("", "refused"), ("1", "published"), ("10", "conflict"), ("2", "published"), ("3", "refused"), ("4", "refused")]
    assert outcomes(first) == want and files(spark, root) == {"one": "first", "two": "second é"}
    # Attempts of the same run, repeated because their executor was lost, know their own folders.
    staged = spark.read.parquet(f"{root}/_runs/a/_staged")
    assert outcomes(sink.commit_documents(staged, root, "a")) == want
    again = sink.publish_documents(spark.createDataFrame([("1", "one", "other text"), ("5", "five", "fifth")], SCHEMA), root)
    assert outcomes(again) == [("1", "conflict"), ("5", "published")] and files(spark, root) == {"one": "first", "two": "second é", "five": "fifth"}
    assert sink.publish_documents(docs.limit(0), root).count() == 0


def test_run_lost_between_writing_and_moving(spark, tmp_path):
    root = f"file://{tmp_path}/skills"
    docs = spark.createDataFrame([("1", "one", "first"), ("2", "two", "second")], SCHEMA)
    staged = sink.stage_documents(docs, root, "lost")
    assert {r.outcome for r in staged.collect()} == {"staged"} and not (tmp_path / "skills/one").exists()
    # One folder was moved before the run was lost; the same run, taken up again, finds it and goes on; another one meets a conflict.
    sink.commit_documents(staged.where("slug = 'one'"), root, "lost").collect()
    assert outcomes(sink.commit_documents(staged, root, "lost")) == [("1", "published"), ("2", "published")]
    assert outcomes(sink.publish_documents(docs, root, "next")) == [("1", "conflict"), ("2", "conflict")]
    assert files(spark, root) == {"one": "first", "two": "second"}


def test_candidates_move_with_their_files(spark, tmp_path):
    root = f"file://{tmp_path}/skills"
    texts = [c for c in COLUMNS if c not in ("success_evidence", "confidence", "one_off_risk", "secret_risk", "version")]
    row = lambda i, status: {c: "" for c in texts} | {"id": i, "payload": "{}", "status": status, "success_evidence": [], "confidence": 0.5, "one_off_risk": 0.0, "secret_risk": 0.0, "version": 3}
    schema = ", ".join(f"{c} " + ("array<string>" if c == "success_evidence" else "long" if c == "version" else "string" if c in texts else "double") for c in COLUMNS)
    log = spark.createDataFrame([row("a", "approved"), row("b", "draft"), row("c", "approved")], schema)
    docs = spark.createDataFrame([("a", "slug-a", "A"), ("b", "slug-b", "B"), ("c", "slug-a", "C"), ("x", "slug-x", "X")], SCHEMA)

    def fails(batch):
        raise OSError("the log cannot be written")

    with pytest.raises(OSError, match="cannot be written"):
        sink.publish_candidates(log, docs, root, "now", fails)
    assert files(spark, root) == {}  # so that the next run is not blocked
    recorded = []
    got = sink.publish_candidates(log, docs, root, "now", lambda batch: recorded.extend([batch.versions.collect(), batch.events.collect()]))
    assert outcomes(got) == [("a", "published"), ("b", "not_approved"), ("c", "conflict"), ("x", "missing")]
    assert [(r.id, r.status, r.version) for r in recorded[0]] == [("a", "published", 4)] and files(spark, root) == {"slug-a": "A"}
    assert [(e.candidate_id, e.action, e.reason) for e in recorded[1]] == [("a", "transition", f"published {root}/slug-a")]


def test_digest_of_sessions(spark):
    """Sessions whose title gives no slug are named by a digest of their messages in order, which no row holds together."""
    said = [("a", "user", "修复解析器"), ("a", "assistant", "好的 done"), ("b", "user", "修复"), ("a", "user", "谢谢\nthanks"), ("b", "assistant", "all tests passed")]
    talk = made(spark, said).repartition(3)
    got = {r.session_id: (r.title, r.slug) for r in skills.bundles(talk, ["tool", "session_id"]).collect()}
    for session, (title, slug) in got.items():
        text = "\0".join([title, *(f"{role}\0{text}" for s, role, text in said if s == session)])
        assert slug == "skill-" + hashlib.sha256(text.encode()).hexdigest()[:8]
    assert sorted(got) == ["a", "b"]


def test_split_slugs(spark):
    cases = {"": "split-skill", "short": "short-part-2", "a" * 70: "a" * 57 + "-part-2", "a" * 56 + "-b": "a" * 56 + "-part-2"}
    rows = spark.createDataFrame([(s,) for s in cases], "slug string")
    assert {r.slug: r.cut for r in rows.select("slug", skills.split_slug(F.col("slug")).alias("cut")).collect()} == cases
