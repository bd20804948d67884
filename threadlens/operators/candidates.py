"""Candidates as an append-only log of versions: the latest of each, its allowed transitions, and what replaced it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import canonical_json, json_number, json_object, json_string, json_strings

# The states that may follow a state.
TRANSITIONS = {
    "detected": ["draft", "disabled", "deleted"],
    "draft": ["in_review", "disabled", "deleted"],
    "in_review": ["approved", "rejected", "deferred", "failed", "disabled", "deleted"],
    "approved": ["published", "disabled", "deleted"],
    "published": ["disabled", "deleted"],
    "rejected": ["draft", "deferred", "disabled", "deleted"],
    "deferred": ["draft", "in_review", "disabled", "deleted"],
    "failed": ["draft", "in_review", "deferred", "disabled", "deleted"],
    "disabled": ["draft", "deleted"],
    "deleted": [],
}


def latest(log: DataFrame) -> DataFrame:
    """The newest version of every candidate, as one aggregation that combines before the shuffle."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("row")).select("id", *[F.col("row")[c].alias(c) for c in rest])


def superseded(current: DataFrame, replacements: DataFrame) -> DataFrame:
    """Candidates with what replaced them, one step on; replacements are (candidate_id, replacement_id)."""
    r = replacements.select(F.col("candidate_id").alias("id"), "replacement_id")
    return current.join(r, "id", "left").withColumn("is_superseded", F.col("replacement_id").isNotNull())


# Changes. A batch is what is to be appended to the logs of versions, events and supersessions; nothing is updated in place. -----------


@dataclass
class Batch:
    """Rows to append: versions (COLUMNS), events (EVENTS) and supersessions (candidate_id, replacement_id, kind)."""

    versions: DataFrame
    events: DataFrame
    supersessions: DataFrame | None = None


COLUMNS = [
    "id", "session_id", "tool", "source_path", "kind", "title", "summary", "payload", "status", "created_at", "updated_at", "deleted_at",
    "confidence", "success_evidence", "one_off_risk", "secret_risk", "recommended_action", "version",
]
EVENTS = ["candidate_id", "session_id", "action", "actor", "reason", "timestamp", "before_hash", "after_hash"]

#: Fixed value: how the event of a replaced candidate names its replacement.
REPLACED_BY = "replaced by edit "


def candidate_hash(row: Callable[[str], Column] = F.col) -> Column:
    """The SHA-256 of a candidate's fields as JSON, in their order."""

    def value(name: str) -> Column:
        if name == "payload":
            return F.coalesce(row(name), F.lit("{}"))
        if name == "success_evidence":
            return json_strings(row(name))
        if name in ("confidence", "one_off_risk", "secret_risk"):
            return json_number(row(name))
        return row(name).cast("string") if name == "version" else json_string(row(name))

    return F.sha2(json_object({name: value(name) for name in COLUMNS}), 256)


def _events(rows: DataFrame, action: Column, before: Column, after: Column, now: str) -> DataFrame:
    return rows.select(
        F.col("id").alias("candidate_id"), "session_id", action.alias("action"), F.coalesce("actor", F.lit("")).alias("actor"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.lit(now).alias("timestamp"), before.alias("before_hash"), after.alias("after_hash"),
    )


def prepared(inputs: DataFrame, now: str) -> DataFrame:
    """Inputs as first versions: default status, canonical payload, risks within 0 and 1; those of no valid status or payload are left out."""

    def risk(name: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(name).cast("double"), F.lit(0.0)))).alias(name)

    status = F.when(F.trim(F.coalesce("status", F.lit(""))) == "", "detected").otherwise(F.trim("status"))
    rows = inputs.withColumn("status", status).withColumn("payload", canonical_json(F.col("payload"))).where(F.col("status").isin([s for s in TRANSITIONS if s != "deleted"]) & F.col("payload").isNotNull())
    texts = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("session_id", "tool", "source_path", "kind", "title", "summary", "recommended_action")}
    made = {
        **texts, "id": F.trim("id").alias("id"), "payload": F.col("payload"), "status": F.col("status"), "created_at": F.lit(now).alias("created_at"), "updated_at": F.lit(now).alias("updated_at"),
        "deleted_at": F.lit("").alias("deleted_at"), **{c: risk(c) for c in ("confidence", "one_off_risk", "secret_risk")},
        "success_evidence": F.coalesce("success_evidence", F.array().cast("array<string>")).alias("success_evidence"), "version": F.lit(1).cast("long").alias("version"),
    }
    return rows.select(*[made[c] for c in COLUMNS], "actor", "reason")


def create(inputs: DataFrame, now: str) -> Batch:
    """First versions of new candidates, each with an event."""
    rows = prepared(inputs, now)
    return Batch(rows.select(*COLUMNS), _events(rows, F.lit("create"), F.lit(""), candidate_hash(), now))


def _moved(rows: DataFrame, status: Column, now: str) -> dict[str, Column]:
    """The columns of the next version of a candidate that goes to a status."""
    changed = {"status": status, "updated_at": F.lit(now), "deleted_at": F.when(status == "deleted", F.lit(now)).otherwise(F.col("deleted_at")), "version": F.col("version") + 1}
    return {c: changed.get(c, F.col(c)) for c in COLUMNS}


def trash(log: DataFrame) -> DataFrame:
    """Deleted candidates with `previous`, their last version before; the log of versions is the trash."""
    rest = [c for c in log.columns if c != "id"]
    whole = F.struct(*rest)
    last = log.groupBy("id").agg(F.max_by(whole, "version").alias("now"), F.max_by(F.when(F.col("status") != "deleted", whole), F.when(F.col("status") != "deleted", F.col("version"))).alias("previous"))
    return last.where("now.status = 'deleted'").select("id", *[F.col("now")[c].alias(c) for c in rest], "previous")


def replace(current: DataFrame, inputs: DataFrame, now: str) -> Batch:
    """New candidates (inputs with `old_id`) that supersede old ones: the old ones are deleted, if their status allows it, in the same batch.

    A candidate is replaced once, by the first of its inputs by id, as it is gone then; inputs whose id is taken or comes twice are refused.
    """
    inputs = inputs.withColumn("id", F.trim("id")).join(current.select(F.trim("id").alias("id")), "id", "left_anti")
    for key, order in (("old_id", "id"), ("id", "old_id")):
        inputs = inputs.groupBy(key).agg(F.min_by(F.struct(*[c for c in inputs.columns if c != key]), order).alias("one")).select(key, "one.*")
    may_go = [s for s, to in TRANSITIONS.items() if "deleted" in to]
    old = current.where(F.col("status").isin(may_go))
    allowed = inputs.join(old.select(F.col("id").alias("old_id")), "old_id", "left_semi")
    new = prepared(allowed, now)
    pairs = new.select(F.col("id").alias("replacement_id"), "kind", "actor", F.col("reason").alias("why")).join(inputs.select(F.trim("id").alias("replacement_id"), "old_id"), "replacement_id")
    gone = old.join(pairs.select(F.col("old_id").alias("id"), "replacement_id", "actor"), "id").withColumn("reason", F.concat(F.lit(REPLACED_BY), "replacement_id"))
    after = _moved(gone, F.lit("deleted"), now)
    events = _events(new, F.lit("create"), F.lit(""), candidate_hash(), now).unionByName(_events(gone, F.lit("delete"), candidate_hash(), candidate_hash(after.__getitem__), now))
    versions = new.select(*COLUMNS).unionByName(gone.select(*[v.alias(c) for c, v in after.items()]))
    return Batch(versions, events, pairs.select(F.col("old_id").alias("candidate_id"), "replacement_id", "kind"))


def supersessions_of(events: DataFrame, current: DataFrame) -> DataFrame:
    """Supersessions that the events of deletion tell of, for logs that have none of their own; the replacement must be known."""
    told = events.where((F.col("action") == "delete") & F.col("reason").startswith(REPLACED_BY))
    told = told.select("candidate_id", F.trim(F.substring("reason", len(REPLACED_BY) + 1, 1 << 20)).alias("replacement_id"))
    kinds = current.select(F.col("id").alias("candidate_id"), "kind")
    return told.join(kinds, "candidate_id").join(current.select(F.col("id").alias("replacement_id")), "replacement_id", "left_semi").select("candidate_id", "replacement_id", "kind").distinct()


# Lists ---------------------------------------------------------------------------------------------------------------------------------


def list_candidates(current: DataFrame, *, status: str = "", include_deleted: bool = False, session_id: str = "", kind: str = "", limit: int = 0) -> DataFrame:
    """Candidates, the last updated first."""
    if status and status not in TRANSITIONS:
        raise ValueError(f"no such status: {status}")
    rows = current.where(F.col("status") == status) if status else current if include_deleted else current.where("status <> 'deleted'")
    for column, value in (("session_id", session_id), ("kind", kind)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.orderBy(F.desc("updated_at"), "id")
    return rows.limit(limit) if limit > 0 else rows


def list_events(events: DataFrame, candidate_id: str) -> DataFrame:
    """The audit trail of a candidate, in the order of its times and hashes."""
    return events.where(F.col("candidate_id") == candidate_id).orderBy("timestamp", "before_hash", "after_hash")


def statuses() -> list[str]:
    return sorted(TRANSITIONS)
