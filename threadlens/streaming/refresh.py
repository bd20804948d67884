"""Incremental refresh as a file stream: each run reads the transcript files that it has not seen, and ends.

A table is a folder of versions, each of which holds some of the table's buckets, by hash of the source. A batch writes anew only the
buckets that its sources fall into, so its cost follows what arrives; the table is the newest folder of every bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; a table keeps the number it was made with.
BUCKETS = 64
BUCKET, FULL = "threadlens_bucket", "-full"


def refresh(spark: SparkSession, inbox: str, schema: str, target: str, checkpoint: str, *, key: str = "source_path", buckets: int = BUCKETS) -> None:
    """Messages in Parquet files that arrive in `inbox` replace those of the same source in the table at `target`.

    A batch is written as a version of its own, named by its number, so a repeated batch writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        write_version(spark, target, number, batch, key=key, buckets=buckets)

    stream = spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(merge)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_version(spark: SparkSession, target: str, number: int, batch: DataFrame, *, gone: DataFrame | None = None, key: str = "source_path", buckets: int = BUCKETS, order: list[str] = ()) -> None:
    """Version `number` of the table: the rows of the batch in place of those with the same key, without those with a key in `gone`."""
    batch = _bucketed(batch, key, buckets)
    leaving = batch.select(BUCKET, key) if gone is None else batch.select(BUCKET, key).unionByName(_bucketed(gone.select(key), key, buckets))
    touched = [r[0] for r in leaving.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
    there = _newest(spark, target, below=number)
    if any(b.rpartition("-")[2] != str(buckets) for b in there):
        raise ValueError(f"{target} was not made with {buckets} buckets")
    old = [there[b] for b in touched if b in there]
    if not old:
        _write(batch, f"{target}/version={number:010d}", order)
        return
    kept = _bucketed(spark.read.parquet(*old), key, buckets).join(leaving.select(key).distinct(), key, "left_anti")
    _write(kept.unionByName(batch), f"{target}/version={number:010d}", order)
    # A bucket of which no row is left has no folder of its own: an empty one says so.
    written = _buckets(spark, f"{target}/version={number:010d}")
    for b in touched:
        if b in there and b not in written:
            fs, folder = _folder(spark, f"{target}/version={number:010d}/{BUCKET}={b}")
            batch.limit(0).drop(BUCKET).write.parquet(folder.toString())


def rebuild(messages: DataFrame, target: str, *, key: str = "source_path", buckets: int = BUCKETS, order: list[str] = ()) -> None:
    """The table at `target` is these messages alone from now on; later refreshes go on from there. Not to be called during a refresh."""
    numbers = [n for n, _, _ in _versions(messages.sparkSession, target)]
    _write(_bucketed(messages, key, buckets), f"{target}/version={max(numbers, default=-1):010d}{FULL}", order)


def read_table(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The table as of its newest version, or the newest before version `below`; None where it has no rows."""
    there = _newest(spark, target, below)
    return spark.read.parquet(*there.values()) if there else None


def vacuum(spark: SparkSession, target: str) -> int:
    """Delete the folders of buckets that newer versions replace, and their number. Not to be called while the table is read or refreshed."""
    keep = set(_newest(spark, target).values())
    old = [path for _, _, version in _versions(spark, target) for path in _buckets(spark, version).values() if path not in keep]
    for path in old:
        fs, folder = _folder(spark, path)
        fs.delete(folder, True)
    return len(old)


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.concat(F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(f"-of-{buckets}")))


def _write(rows: DataFrame, path: str, order: list[str] = ()) -> None:
    # Rebalancing splits a bucket with one large source among tasks, where plain repartitioning would not.
    dealt = rows.hint("rebalance", F.col(BUCKET))
    (dealt.sortWithinPartitions(BUCKET, *order) if order else dealt).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def _versions(spark: SparkSession, target: str) -> list[tuple[int, bool, str]]:
    """Number, whether it is a rebuilt one, and path of the complete versions, in order."""
    found = [(int(n.removesuffix(FULL)), n.endswith(FULL), f"{target}/version={n}") for n in _children(spark, target, "version=")]
    return sorted(v for v in found if _children(spark, v[2], "_SUCCESS"))


def _buckets(spark: SparkSession, version: str) -> dict[str, str]:
    return {b: f"{version}/{BUCKET}={b}" for b in _children(spark, version, f"{BUCKET}=")}


def _newest(spark: SparkSession, target: str, below: int | None = None) -> dict[str, str]:
    """The newest folder of each bucket."""
    there: dict[str, str] = {}
    for number, full, version in _versions(spark, target):
        if below is None or number < below:
            there = {} if full else there
            there |= _buckets(spark, version)
    return there


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events per user, closed by a gap, on a stream or a table."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
