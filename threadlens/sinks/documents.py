"""Documents as files, a folder each: <root>/<slug>/SKILL.md, never overwritten.

A run writes all documents below <root>/_runs/<run>, each under the temporary name of its task's attempt and then renamed; only then are
the folders moved to their places, each by one rename. A folder has a mark of its run and candidate, so an attempt that is repeated after
its executor was lost knows its own folders from others', which are conflicts. What a run that was lost before moving leaves
behind is below _runs and in nobody's way.

publish_candidates() moves candidates to `published` in the log, for just those whose folders are there. If recording that fails, the
run's folders are removed again, so the next run is not blocked by them.

Outcomes: published; conflict (the slug is taken, or an earlier candidate of the run takes it); refused (no document, or no valid slug);
not_approved; missing. A null or repeated id is a row of its own; of rows with the same slug the least id comes first; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions import text as T
from ..operators import requests
from ..operators.candidates import Batch, latest

FILE, MARK = "SKILL.md", ".run"

#: The longest slug, and who publishes.
SLUG_CHARS, PUBLISHER = 64, "user"


def _fs(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _read(fs: pafs.FileSystem, path: str) -> bytes | None:
    if not _there(fs, path):
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def _mark(run: str, row: dict) -> bytes:
    return f"{run}\n{row['id']}\n{row['place']}".encode()


def _each(rows: DataFrame, work: Callable[[dict], str]) -> DataFrame:
    """The rows with what work(row) tells of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "slug", "place")] + [pa.array([work(r) for r in batch.to_pylist()], pa.string())], ["id", "slug", "place", "outcome"])

    return rows.mapInArrow(run, "id string, slug string, place long, outcome string")


def _keep(df: DataFrame, root: str, run: str, name: str) -> DataFrame:
    path = f"{root}/_runs/{run}/_{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_documents(documents: DataFrame, root: str, run: str) -> DataFrame:
    """Write the documents (id, slug, document) of a run where they wait for their places: `id`, `slug`, `place` and `outcome`, staged or refused."""
    valid = (F.length("slug") <= SLUG_CHARS) & T.matches(F.col("slug"), R.SLUG) & F.col("document").isNotNull()
    rows = documents.select(F.col("id").cast("string").alias("id"), F.coalesce("slug", F.lit("")).alias("slug"), "document", F.coalesce(valid, F.lit(False)).alias("valid"))
    rows = _keep(rows.withColumn("place", F.monotonically_increasing_id()), root, run, "documents")

    def write(row: dict) -> str:
        if not row["valid"]:
            return "refused"
        fs, base = _fs(root)
        waiting = f"{base}/_runs/{run}/{row['place']}"
        attempt = f"{waiting}.{TaskContext.get().taskAttemptId()}"
        fs.create_dir(attempt, recursive=True)
        for name, data in ((FILE, row["document"].encode()), (MARK, _mark(run, row))):
            with fs.open_output_stream(f"{attempt}/{name}") as f:
                f.write(data)
        if _there(fs, waiting):
            fs.delete_dir(attempt)
        else:
            fs.move(attempt, waiting)
        return "staged"

    return _keep(_each(rows, write), root, run, "staged")


def commit_documents(staged: DataFrame, root: str, run: str) -> DataFrame:
    """Move what is staged to its place, in the order of ids where slugs are equal; `outcome` is published, conflict or refused."""

    def move(row: dict) -> str:
        if row["outcome"] != "staged":
            return row["outcome"]
        fs, base = _fs(root)
        target, waiting = f"{base}/{row['slug']}", f"{base}/_runs/{run}/{row['place']}"
        if not _there(fs, target):
            try:
                fs.move(waiting, target)
            except OSError:
                pass  # another run was faster, or an earlier attempt of this task
        return "published" if _read(fs, f"{target}/{MARK}") == _mark(run, row) else "conflict"

    order = [F.col("slug"), F.col("id").try_cast("long"), F.col("id"), F.col("place")]
    return _each(staged.repartition("slug").sortWithinPartitions(*order), move)


def remove_documents(published: DataFrame, root: str, run: str) -> int:
    """Remove the folders of a run again, and only its own; how many there were."""

    def remove(row: dict) -> str:
        fs, base = _fs(root)
        target = f"{base}/{row['slug']}"
        if row["outcome"] != "published" or _read(fs, f"{target}/{MARK}") != _mark(run, row):
            return "kept"
        fs.delete_dir(target)
        return "removed"

    return _keep(_each(published, remove), root, run, f"removed-{uuid.uuid4().hex}").where("outcome = 'removed'").count()


def publish_documents(documents: DataFrame, root: str, run: str | None = None) -> DataFrame:
    """Publish documents (id, slug, document); one row each: `id`, `slug`, `place`, `outcome`. A run that is repeated gives the same outcomes."""
    run = run or uuid.uuid4().hex
    return _keep(commit_documents(stage_documents(documents, root, run), root, run), root, run, f"outcomes-{uuid.uuid4().hex}")


def publish_candidates(log: DataFrame, documents: DataFrame, root: str, now: str, record: Callable[[Batch], None]) -> DataFrame:
    """Publish the documents (id, slug, document) of approved candidates and record() the versions and events that say so.

    If record() fails, what this run published is removed and the error goes on.
    """
    run = uuid.uuid4().hex
    state = latest(log.select(F.col("id").cast("string").alias("id"), "status", "version")).select("id", "status", F.col("version").alias("at_version"))
    asked = _keep(documents.select(F.col("id").cast("string").alias("id"), "slug", "document").join(state, "id", "left"), root, run, "asked")
    outcomes = publish_documents(asked.where("status = 'approved'"), root, run)
    try:
        done = outcomes.where("outcome = 'published'").join(asked.select("id", "at_version").distinct(), "id")
        reason = F.concat(F.lit(f"published {root}/"), "slug")
        moves = done.select("id", "place", F.lit("published").alias("to_status"), F.col("at_version").alias("version"), F.lit(PUBLISHER).alias("actor"), reason.alias("reason"))
        record(requests.apply(log, moves.withColumnRenamed("place", "seq"), now)[1])
    except Exception:
        remove_documents(outcomes, root, run)
        raise
    others = asked.where("status IS NULL OR status <> 'approved'")
    told = F.when(F.col("status").isNull(), "missing").otherwise("not_approved")
    return outcomes.select("id", "slug", "outcome").unionByName(others.select("id", "slug", told.alias("outcome")))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """slug and document of everything published."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", FILE).load(f"{root}/*/")
    return found.select(F.regexp_extract("path", rf"([^/]+)/{FILE}$", 1).alias("slug"), F.decode("content", "UTF-8").alias("document")).where(~F.col("slug").startswith("_"))
