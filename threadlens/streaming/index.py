"""The index of all transcripts below home folders: each run reads what has changed and writes one new version of the table.

Sources are listed with their signatures (time and size). Those whose signature is not the one in the table are tried first, each in a
task: a source that cannot be opened is a row of the report, keeps its old rows and is tried again by the next run. The others are
read by Spark's readers; files of no bytes are not listed. Session databases are compared session by session: of each only sessions that are new, whose time has
changed, or that are gone are touched. Sources that have vanished keep their rows.

The table has the message columns and `unit`, what is replaced as a whole: a source, or a session of a database. A row without a line stands for
a source, with its mtime and size, or for a session, with its `updated`; it is written in the same version as the messages it stands for,
so a run that is lost leaves nothing half done and the next one does its work again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import to_refresh
from ..sources.discovery import read_all, sources
from ..sources.jsonl import COLUMNS, plain_path
from ..sources.opencode import list_sessions, session_parts, told
from .refresh import BUCKETS, FULL, _bucketed, _folder, _versions, _write, read_table, write_version

SCHEMA = "unit string, tool string, session_id string, cwd string, title string, ts double, role string, text string, source_path string, line string, mtime double, size long, updated long"
REPORT = ["tool", "source_path", "outcome", "sessions", "removed", "messages", "error"]


def messages_of(table: DataFrame) -> DataFrame:
    return table.where("line IS NOT NULL").select(*COLUMNS)


def _tried(changed: DataFrame) -> DataFrame:
    """The sources with the error of opening them, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for path in batch.column("source_path").to_pylist():
                try:
                    local = path.startswith(("file:", "/"))
                    fs, place = (pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else pafs.FileSystem.from_uri(path)
                    with fs.open_input_stream(place) as f:
                        f.read(1)
                    errors.append(None)
                except pa.ArrowNotImplementedError:
                    errors.append(None)  # a store that only Spark's readers know
                except (OSError, pa.ArrowException) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], [*batch.schema.names, "error"])

    return changed.select("tool", "source_path", "mtime", "size").repartition("source_path").mapInArrow(run, "tool string, source_path string, mtime double, size long, error string")


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the table: the columns given, those that df has, and nulls."""
    names = [c.split(" ") for c in SCHEMA.split(", ")]
    return df.select(*[columns[n].cast("bigint" if t == "long" else t).alias(n) if n in columns else F.col(n) if n in df.columns else F.lit(None).cast("bigint" if t == "long" else t).alias(n) for n, t in names])


def index_home(spark: SparkSession, home: str | list[str], target: str, *, full: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Bring the table at `target` up to date; the report has a row per source: outcome, sessions and messages read, sessions removed, error.

    Outcomes: read, unchanged, failed, vanished. With full=True everything is read and the table holds nothing else.
    """
    work = f"{target}/_work-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    versions = _versions(spark, target)
    table = None if full else read_table(spark, target)
    known = (spark.createDataFrame([], SCHEMA) if table is None else table.where("line IS NULL")).select("unit", "tool", "session_id", "source_path", "mtime", "size", "updated")
    known = keep(known, "known")
    found = keep(sources(spark, home), "sources")
    is_db = F.col("tool") == "opencode"

    # Files: those with another signature, if they can be opened.
    files, stored = found.where(~is_db), known.where(~is_db)
    tried = keep(_tried(to_refresh(files, stored, "source_path", ["mtime", "size"])), "tried")
    good = tried.where("error IS NULL")
    parts = [_rows(good, unit=F.col("source_path"))]
    if not good.isEmpty():
        said = read_all(spark, good.select("tool", "source_path")).withColumn("source_path", plain_path(F.col("source_path")))
        parts.append(_rows(said, unit=F.col("source_path")))

    # Databases: sessions with another time, and those that are gone.
    dbs = found.where(is_db)
    listed = keep(list_sessions(dbs), "listed")
    tracked = known.where(is_db & F.col("session_id").isNotNull()).select("unit", "source_path", "session_id", F.col("updated").alias("time_updated"))
    here = listed.where("session_id IS NOT NULL")
    changed = keep(here.join(tracked, ["source_path", "session_id", "time_updated"], "left_anti"), "changed")
    raw = keep(session_parts(changed), "parts")
    broken = keep(listed.where("error IS NOT NULL").select("source_path", "error").unionByName(raw.where("error IS NOT NULL").select("source_path", "error")).groupBy("source_path").agg(F.min("error").alias("error")), "broken")
    whole = dbs.join(broken, "source_path", "left_anti")
    unit = F.concat("source_path", F.lit("#"), "session_id")
    fresh = changed.join(whole, "source_path", "left_semi")
    gone = keep(tracked.join(whole, "source_path", "left_semi").join(here, ["source_path", "session_id"], "left_anti").select("unit", "source_path"), "gone")
    parts.append(_rows(fresh, unit=unit, tool=F.lit("opencode"), updated=F.col("time_updated")))
    parts.append(_rows(told(raw.where("error IS NULL").join(whole, "source_path", "left_semi"), fresh, "source_path"), unit=unit))
    parts.append(_rows(to_refresh(whole, known.where(is_db), "source_path", ["mtime", "size"]), unit=F.col("source_path")))

    batch = parts[0]
    for more in parts[1:]:
        batch = batch.unionByName(more)
    batch = keep(batch, "batch")
    number = max((n for n, _, _ in versions), default=-1) + 1
    if full:
        _write(_bucketed(batch, "unit", buckets), f"{target}/version={number:010d}{FULL}")
    elif not (batch.isEmpty() and gone.isEmpty()):
        write_version(spark, target, number, batch, gone=gone, key="unit", buckets=buckets)

    counts = batch.where("line IS NOT NULL").groupBy("source_path").agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("read_sessions"))
    removed = gone.groupBy("source_path").agg(F.count("*").alias("removed"))
    changes = fresh.groupBy("source_path").agg(F.count("*").alias("changed"))
    errors = tried.where("error IS NOT NULL").select("source_path", "error").unionByName(broken)
    seen = found.select("tool", "source_path").join(tried.select("source_path", F.lit(True).alias("asked")), "source_path", "left").join(errors, "source_path", "left")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("asked") | is_db, "read").otherwise("unchanged")
    lost = known.select("tool", "source_path").distinct().join(found, "source_path", "left_anti").select("tool", "source_path", F.lit("vanished").alias("outcome"), F.lit(None).cast("string").alias("error"))
    report = seen.select("tool", "source_path", outcome.alias("outcome"), "error").unionByName(lost)
    for more in (counts, removed, changes):
        report = report.join(more, "source_path", "left")
    zero = lambda *c: F.coalesce(*c, F.lit(0).cast("long"))
    report = report.select("tool", "source_path", "outcome", zero("changed", "read_sessions").alias("sessions"), zero("removed").alias("removed"), zero("messages").alias("messages"), "error")
    path = f"{target}/_reports/{number:010d}-{uuid.uuid4().hex}"
    report.write.parquet(path)
    fs, folder = _folder(spark, work)
    fs.delete(folder, True)
    return spark.read.schema(report.schema).parquet(path)
