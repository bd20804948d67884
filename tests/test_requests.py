"""Requests of candidates where both their states and the requests are partitioned by id before they meet, as large logs are."""

import pytest

from threadlens.operators import candidates, requests

NOW = "2024-06-01T00:00:00Z"
LOG = "id string, session_id string, tool string, source_path string, kind string, title string, summary string, payload string, status string, created_at string, updated_at string, deleted_at string, confidence double, success_evidence array<string>, one_off_risk double, secret_risk double, recommended_action string, version long"


#: No table is small enough to be broadcast, and Spark merges partitions of each side of a union by that side's sizes.
LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}


@pytest.fixture
def shuffled(spark):
    old = {k: spark.conf.get(k) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def log_of(spark, n):
    """Candidates of which every second is deleted, with the version before."""
    row = lambda i, status, version: (f"c{i}", "s", "t", "/p", "skill", "T", "S", "{}", status, "", "", "", 0.5, [], 0.5, 0.0, "draft", version)
    return spark.createDataFrame([row(i, "draft", 1) for i in range(n)] + [row(i, "deleted", 2) for i in range(0, n, 2)], LOG)


def test_deletion_of_current_candidates(shuffled):
    current = candidates.latest(log_of(shuffled, 60))
    asked = current.selectExpr("id", "'deleted' AS to_status", "version", "'me' AS actor", "'why' AS reason")
    assert {r.id: r.outcome for r in requests.answered(current, asked).collect()} == {f"c{i}": "done" if i % 2 else "invalid" for i in range(60)}


def test_restoring_each_candidate_once(shuffled):
    log = log_of(shuffled, 600)
    found, _ = requests.restore(log, log.select("id").distinct().selectExpr("id", "'me' AS actor", "'' AS reason"), NOW)
    assert {r.id: r.outcome for r in found.collect()} == {f"c{i}": "not_deleted" if i % 2 else "done" for i in range(600)}


def test_states_and_requests_meet_by_a_join(shuffled):
    """A union of both hands on the partitioning that its sides have in common, with which Spark leaves exchanges out."""
    log = log_of(shuffled, 60)
    asked = log.select("id").distinct().selectExpr("id", "'restore' AS action", "cast(null AS string) AS to_status").unionAll(shuffled.sql("SELECT null, 'restore', null UNION ALL SELECT null, 'delete', null UNION ALL SELECT 'new', 'delete', null"))
    plan = requests.answered(log, asked.distinct())
    assert {(r.id, r.place): r.outcome for r in plan.where("id IS NULL OR id = 'new'").collect()} == {(None, 1): "missing", ("new", 1): "missing"}
    found, batch = requests.restore(log, log.select("id").distinct().selectExpr("id", "'me' AS actor", "'' AS reason"), NOW)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert batch.versions.count() == batch.events.count() == 30
