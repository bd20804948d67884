"""Readers of session databases in SQLite.

A Python data source hands out whole tables, one partition per database file; Spark joins them. For incremental reading, a table of
databases is turned into one of their sessions, and a table of sessions into the messages of just these, in the tasks that hold its rows.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

SCHEMAS = {
    "session": "path string, id string, directory string, title string, time_updated long",
    "message": "path string, id string, session_id string, time_created long, data string",
    "part": "path string, id string, message_id string, time_created long, data string",
}


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "threadlens_sqlite"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","), self.options["table"])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str) -> None:
        self.paths, self.table = paths, table

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = [c.split()[0] for c in SCHEMAS[self.table].split(", ")][1:]
        db = sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)
        try:
            for row in db.execute(f"SELECT {', '.join(columns)} FROM {self.table}"):
                yield (partition.value, *row)
        finally:
            db.close()


def read_opencode(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Message rows; the parts of a message are joined by line feeds in their order."""
    spark.dataSource.register(SqliteTable)
    of = lambda name: spark.read.format("threadlens_sqlite").option("path", ",".join(paths)).option("table", name).load()
    s, m, p = of("session"), of("message"), of("part")
    m = m.select("path", F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("message_at"), F.col("data").alias("message_data"))
    p = p.select("path", "message_id", F.col("id").alias("part_id"), F.col("time_created").alias("part_at"), F.col("data").alias("part_data"))
    s = s.select("path", F.col("id").alias("session_id"), "directory", "title")
    return told(p.join(m, ["path", "message_id"]), s, "path")


def told(parts: DataFrame, sessions: DataFrame, path: str) -> DataFrame:
    """Message rows from parts (with their message's time and data) and sessions, both with a column that names the database."""
    part = parts.withColumn("text", F.get_json_object("part_data", "$.text")).where("text <> ''")
    one = F.struct(F.col("part_at").alias("at"), "part_id", "text")
    whole = part.groupBy(path, "session_id", "message_id").agg(F.first("message_at").alias("message_at"), F.first("message_data").alias("message_data"), F.array_sort(F.collect_list(one)).alias("parts"))
    rows = whole.join(sessions.select(path, "session_id", F.coalesce("directory", F.lit("")).alias("cwd"), F.coalesce("title", F.lit("")).alias("title")), [path, "session_id"])
    rows = rows.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), "\n")).withColumn("raw_role", F.get_json_object("message_data", "$.role"))
    at = F.coalesce("message_at", F.col("parts")[0]["at"])
    return rows.select(
        F.lit("opencode").alias("tool"), "session_id", "cwd", "title", F.when(at > 1e10, at / 1000).otherwise(at.cast("double")).alias("ts"),
        T.normalize_role(F.col("raw_role"), F.col("text")).alias("role"), "text", F.col(path).alias("source_path"), F.col("message_id").alias("line"),
    )


SESSIONS = "source_path string, session_id string, directory string, title string, time_updated long, error string"
PARTS = "source_path string, session_id string, message_id string, message_at long, message_data string, part_id string, part_at long, part_data string, error string"

#: Sessions that are asked for in one statement.
ASKED = 500


def _connect(path: str) -> sqlite3.Connection:
    local = path.removeprefix("file:")
    return sqlite3.connect(f"file:{quote('/' + local.lstrip('/'))}?mode=ro", uri=True)


def _whole(value: object) -> int:
    try:
        return int(value or 0)
    except (TypeError, ValueError):
        return 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*[c.split(" ") for c in schema.split(", ")], strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def list_sessions(databases: DataFrame) -> DataFrame:
    """The sessions in each database (source_path); one row without a session, with the error, for a database that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("source_path").to_pylist():
                try:
                    db = _connect(path)
                    try:
                        found = db.execute("SELECT id, directory, title, time_updated FROM session")
                        while rows := found.fetchmany(10_000):
                            yield _batch([(path, str(i), d, t, _whole(u), None) for i, d, t, u in rows], SESSIONS)
                    finally:
                        db.close()
                except sqlite3.Error as e:
                    yield _batch([(path, None, None, None, None, f"{type(e).__name__}: {e}")], SESSIONS)

    return databases.select("source_path").repartition("source_path").mapInArrow(run, SESSIONS)


def session_parts(sessions: DataFrame) -> DataFrame:
    """The parts of the messages of these sessions (source_path, session_id), and rows with an error; no other session is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("source_path").to_pylist(), batch.column("session_id").to_pylist(), strict=True)
            for path, group in groupby(pairs, lambda p: p[0]):
                ids = [i for _, i in group]
                try:
                    db = _connect(path)
                    try:
                        for at in range(0, len(ids), ASKED):
                            some = ids[at : at + ASKED]
                            asked = f"SELECT m.session_id, m.id, m.time_created, m.data, p.id, p.time_created, p.data FROM message m JOIN part p ON p.message_id = m.id WHERE m.session_id IN ({','.join('?' * len(some))})"
                            found = db.execute(asked, some)
                            while rows := found.fetchmany(1_000):
                                yield _batch([(path, *row, None) for row in rows], PARTS)
                    finally:
                        db.close()
                except sqlite3.Error as e:
                    yield _batch([(path, *[None] * 7, f"{type(e).__name__}: {e}")], PARTS)

    dealt = sessions.select("source_path", "session_id").repartition("source_path", "session_id").sortWithinPartitions("source_path", "session_id")
    return dealt.mapInArrow(run, PARTS)
