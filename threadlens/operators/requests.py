"""Many requests to change candidates as one batch: requests of one candidate are answered one after the other, each with one outcome.

A request names a candidate (`id`), its place in order (`seq`) and an action: `transition` to `to_status`, `delete`, `restore`, or a review
towards `to_status`, which takes all steps there or none: `review_decision` (detected, draft, in review, target) and `review_skill` (back
to draft from rejected, to in review from deferred and failed, too). `version`, if not null, must be the candidate's version at that time.

The requests of a candidate, each with the candidate's present state, stream through one task in order; what is kept of it is its status,
its version and the status to which it can be restored, however many requests it has.

Outcomes: done; same (a review that is there already); conflict (another version); invalid (no such step, status or action); missing (no such candidate);
not_deleted and no_snapshot (nothing to restore). Ties in `seq` are in the order of version, action, to_status (last one first), actor and reason; null actors and
reasons are empty; a null id is missing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import COLUMNS, TRANSITIONS, Batch, candidate_hash, latest, trash

ACTIONS = ["transition", "delete", "restore", "review_decision", "review_skill"]

# The steps that lead a candidate into review, with their reasons, and who reviews where no actor is named.
INTO_REVIEW = {
    "review_decision": {"detected": ("draft", "review: draft"), "draft": ("in_review", "review: in_review")},
    "review_skill": {
        "detected": ("draft", "prepare review"), "rejected": ("draft", "prepare review"), "draft": ("in_review", "open review"),
        "deferred": ("in_review", "open review"), "failed": ("in_review", "open review"),
    },
}
VERBS = {"approved": "approve", "rejected": "reject", "deferred": "defer"}
REVIEWER = "reviewer"

STEP = "id string, place long, seq long, action string, actor string, reason string, step int, outcome string, from_status string, to_status string, version long, asked long, restored boolean, fresh boolean"


def steps_to(action: str, status: str, target: str, reason: str) -> list[tuple[str, str]] | None:
    """The statuses on the way to a target with the reason of each step; none if it is there, None if it cannot get there."""
    if action == "transition":
        return [(target, reason)] if target in TRANSITIONS[status] else None
    if target not in VERBS:
        return None
    reason = reason if reason.strip() else f"review {VERBS[target]}" if action == "review_skill" else VERBS[target]
    if action == "review_skill" and status == target:
        return []
    steps = []
    while status in INTO_REVIEW[action]:
        status, why = INTO_REVIEW[action][status]
        steps.append((status, why))
        if len(steps) > len(TRANSITIONS):
            return None
    if action == "review_skill" and status != "in_review" or target not in TRANSITIONS[status]:
        return None
    return [*steps, (target, reason)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests sorted by id, with their candidate's state before the first; one row for each step made, or for a request without any."""
    here: str | None = None
    status: str | None = None
    before: str | None = None  # what a deleted candidate was
    version, restored, fresh, place = 0, False, True, 0
    names = [c.split(" ")[0] for c in STEP.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["id"] is None or r["id"] != here:
                here, status, before, restored, fresh, place = r["id"], r["status"], r["before"], False, True, 0
                version = 0 if status is None else r["at_version"]
            action, target = r["action"], r["to_status"]
            place += 1
            if action == "delete":
                action, target = "transition", "deleted"
            steps: list[tuple[str, str]] | None = None
            if status is None:
                outcome = "missing"
            elif r["version"] is not None and r["version"] != version:
                outcome = "conflict"
            elif action == "restore":
                outcome = "not_deleted" if status != "deleted" else "done" if before in TRANSITIONS and before != "deleted" else "no_snapshot"
                steps = [(before, r["reason"])] if outcome == "done" else None
            elif action in ACTIONS and status in TRANSITIONS:
                steps = steps_to(action, status, target, r["reason"])
                outcome = "invalid" if steps is None else "done" if steps else "same"
            else:
                outcome = "invalid"
            if not steps:
                out.append((r["id"], place, r["seq"], r["action"], r["actor"], r["reason"], 0, outcome, status, target, version, r["version"], restored, fresh))
                continue
            for k, (to, why) in enumerate(steps, 1):
                came = restored
                if to == "deleted":
                    before = status
                elif action == "restore":
                    before = None
                    # What is restored is what was deleted: the stored snapshot, unless this batch deleted it.
                    restored = came or fresh
                out.append((r["id"], place, r["seq"], r["action"], r["actor"], why, k, outcome, status, to, version + 1, r["version"], restored, fresh))
                status, version, fresh = to, version + 1, False
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=_arrow_schema())


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in STEP.split(", "))])


def answered(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests with their outcomes, one row for each step that is made (`step` counts from 1; 0 stands for none)."""
    given = {c.lower() for c in requests.columns}
    column = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in given else F.lit(default).cast(kind)).alias(c)
    asked = requests.select(
        F.col("id").cast("string").alias("id"), column("seq", "long", 0), column("action", "string", "transition"), F.col("to_status") if "to_status" in given else F.lit(None).cast("string").alias("to_status"),
        column("version", "long", None), column("actor", "string", ""), column("reason", "string", ""),
    )
    wanted = asked.select("id").distinct()
    states = log.select(F.col("id").cast("string").alias("id"), "status", "version").join(wanted, "id", "left_semi")
    known, was = latest(states), trash(states).select("id", F.col("previous.status").alias("before"))
    states = known.join(was, "id", "left").select("id", "status", "before", F.col("version").cast("long").alias("at_version"))
    rows = asked.join(states, "id", "left")
    order = [F.col("id"), F.col("seq"), F.col("version"), F.col("action"), F.desc("to_status"), F.col("actor"), F.col("reason")]
    # Not by `id` itself: where the rows are partitioned by it, Spark 4.1 leaves that exchange out, and as the fold asks for no partitioning
    # of its own, partitions of the join may then be split or read otherwise, so that a candidate's requests end up in different tasks.
    return rows.repartition(F.xxhash64("id")).sortWithinPartitions(*order).mapInArrow(_fold, STEP)


def outcomes(steps: DataFrame) -> DataFrame:
    """One row per request with a step or none: its outcome and the last status and version."""
    last = F.max_by(F.struct("outcome", "to_status", "version"), "step").alias("last")
    return steps.groupBy("id", "place").agg(F.first("seq").alias("seq"), F.first("action").alias("action"), last, F.max("step").alias("steps")).select("id", "seq", "action", "steps", "last.*")


def apply(log: DataFrame, requests: DataFrame, now: str) -> tuple[DataFrame, Batch]:
    """The answers, and the versions and events to be appended to the logs: one of each for every step made."""
    steps = answered(log, requests)
    made = steps.where("step > 0")
    touched = log.join(made.select("id").distinct(), "id", "left_semi")
    rest = [c for c in COLUMNS if c != "id"]
    base = latest(touched).select("id", F.struct(*rest).alias("now")).join(trash(touched).select("id", "previous"), "id", "left")
    rows = made.join(base, "id")
    # Contents come from the latest version, or from what a deleted candidate was before, once it is restored.
    source = F.when(F.col("restored"), F.col("previous")).otherwise(F.col("now"))
    was = F.when(F.col("fresh") | ~F.col("restored"), F.col("now")).otherwise(F.col("previous"))

    def row(content, status: str, version, untouched, before: bool):
        deleted = F.when(F.col(status) == "deleted", F.lit(now)).otherwise(F.lit(""))
        changed = {
            "status": F.col(status), "version": version, "updated_at": F.when(untouched, content["updated_at"]).otherwise(F.lit(now)),
            "deleted_at": F.when(untouched, content["deleted_at"]).otherwise(deleted if before else F.when((F.col(status) == "deleted") | (F.col("action") == "restore"), deleted).otherwise(content["deleted_at"])),
        }
        return {c: F.col("id") if c == "id" else changed.get(c, content[c]) for c in COLUMNS}

    old = row(was, "from_status", F.col("version") - 1, F.col("fresh"), True)
    new = row(source, "to_status", F.col("version"), F.lit(False), False)
    versions = rows.select(*[v.alias(c) for c, v in new.items()])
    action = F.when(F.col("to_status") == "deleted", "delete").when(F.col("action") == "restore", "restore").otherwise("transition")
    actor = F.when((F.trim("actor") == "") & F.col("action").startswith("review"), REVIEWER).otherwise(F.col("actor"))
    events = rows.select(
        F.col("id").alias("candidate_id"), new["session_id"].alias("session_id"), action.alias("action"), actor.alias("actor"), "reason", F.lit(now).alias("timestamp"),
        candidate_hash(old.__getitem__).alias("before_hash"), candidate_hash(new.__getitem__).alias("after_hash"),
    )
    return steps, Batch(versions, events)


def transition(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, to_status, version and whatever answered() takes) with their outcomes."""
    found = answered(current, requests)
    kind = requests.schema["id"].dataType
    return found.select(F.col("id").cast(kind).alias("id"), "to_status", F.col("asked").alias("version"), "outcome")


def change_status(current: DataFrame, requests: DataFrame, now: str) -> Batch:
    """New versions and events of the requests (id, to_status, version, actor, reason) that are done; deletion is one of them."""
    return apply(current, requests, now)[1]


def restore(log: DataFrame, requests: DataFrame, now: str) -> tuple[DataFrame, Batch]:
    """The outcome of each request (id, actor, reason) - done, missing, not_deleted, no_snapshot - and the restored versions."""
    steps, batch = apply(log, requests.withColumn("action", F.lit("restore")), now)
    return steps.select("id", "outcome"), batch
