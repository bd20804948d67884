"""Change detection between two listings, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timestamps import format_timestamp
from .sessions import has_prefix


def changes(current: DataFrame, known: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """added, changed, removed or same for each key of either listing; marks are compared with nulls as values."""
    now = current.select(F.col(key).alias("k_now"), F.struct(*marks).alias("now"))
    old = known.select(F.col(key).alias("k_old"), F.struct(*marks).alias("old"))
    joined = now.join(old, F.col("k_now") == F.col("k_old"), "full_outer")
    change = F.when(F.col("k_old").isNull(), "added").when(F.col("k_now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("old")), "same").otherwise("changed")
    return joined.select(F.coalesce("k_now", "k_old").alias(key), change.alias("change"))


def to_refresh(current: DataFrame, known: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """The sources that are new or whose marks differ; vanished ones are left alone."""
    return current.join(known.select(key, *marks), [key, *marks], "left_anti")


def replace_sources(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows of the sources that have no new rows, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pending_sessions(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sessions without any candidate, deleted ones included; a candidate without a tool stands for every tool."""
    named = candidates.where("tool <> ''").select("tool", "session_id").distinct()
    any_tool = candidates.where("tool = ''").select("session_id").distinct()
    return sessions.join(named, ["tool", "session_id"], "left_anti").join(any_tool, "session_id", "left_anti")


def list_pending(sessions: DataFrame, candidates: DataFrame, *, prefix: str = "", cwd: str = "", after: float | None = None) -> DataFrame:
    """Pending physical sessions, the last active first; a session without times counts as active at 0."""
    rows = pending_sessions(sessions, candidates)
    active = F.coalesce("updated", "created", F.lit(0.0))
    if prefix:
        rows = rows.where(has_prefix(prefix))
    if cwd:
        rows = rows.where(T.ascii_lower(F.col("cwd")).contains(T.ascii_lower_of(cwd)))
    if after is not None:
        rows = rows.where(active >= after)
    rows = rows.orderBy(active.desc(), "tool", "session_id", "source_path")
    return rows.select("tool", "session_id", "title", "cwd", "source_path", *[format_timestamp(F.col(c)).alias(c) for c in ("created", "updated")])


def signatures(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source (tool, source_path) the newest time and the total size of it and the files beside it, from a listing (path, mtime, size).

    A source without files has time and size 0.
    """
    folder = F.regexp_replace("source_path", r"[^/]*\z", "")
    more = F.when(F.col("tool") == "grok", F.array(F.concat(folder, F.lit("summary.json")))).when(
        F.col("tool") == "opencode", F.array(F.concat("source_path", F.lit("-wal")), F.concat("source_path", F.lit("-shm")))
    ).otherwise(F.array().cast("array<string>"))
    wanted = sources.select("tool", "source_path", F.explode(F.concat(F.array("source_path"), more)).alias("path"))
    met = wanted.join(files.select("path", "mtime", "size"), "path", "left")
    return met.groupBy("tool", "source_path").agg(F.coalesce(F.max("mtime"), F.lit(0.0)).alias("mtime"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("size"))


def upsert(current: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `changed` take the place of those with the same keys."""
    return current.join(changed, keys, "left_anti").unionByName(changed)
