"""Runs of the index over transcripts that are written from the conversations: files of two tools and a database of sessions per user."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.json_text import json_string
from ..sinks import documents
from ..streaming.index import index_home, messages_of
from ..streaming.refresh import read_table
from .registry import register
from .tables import shared_folder, table

USERS = 8


def _put(path: str, data: bytes) -> None:
    fs, place = pafs.FileSystem.from_uri(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place) as f:
        f.write(data)


def _write_files(files: DataFrame) -> None:
    """Files (path, content), each by the task that holds its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _put(path, content.encode())
            yield batch.slice(0, 0).select(["path"])

    files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def _write_databases(rows: DataFrame) -> None:
    """One database a user (path), of rows (session_id, updated, turn, role, text); a path that ends in `broken` gets no database."""

    def one(found: pd.DataFrame) -> pd.DataFrame:
        path = found["path"].iloc[0]
        if path.endswith("broken"):
            _put(path.removesuffix("broken"), b"this is no database" * 300)
            return pd.DataFrame({"path": pd.Series([], dtype=object)})
        db = sqlite3.connect(":memory:")
        db.executescript("CREATE TABLE session(id, directory, title, time_updated); CREATE TABLE message(id, session_id, time_created, data); CREATE TABLE part(id, message_id, time_created, data)")
        for s, updated in found[["session_id", "updated"]].drop_duplicates().itertuples(index=False):
            db.execute("INSERT INTO session VALUES (?, '/d', 'T', ?)", (s, int(updated)))
        for s, turn, role, text in found[["session_id", "turn", "role_json", "text_json"]].itertuples(index=False):
            db.execute("INSERT INTO message VALUES (?, ?, ?, ?)", (f"{s}-{turn}", s, int(turn), f'{{"role":{role}}}'))
            db.execute("INSERT INTO part VALUES (?, ?, ?, ?)", (f"{s}-{turn}-p", f"{s}-{turn}", int(turn), f'{{"text":{text}}}'))
        db.commit()
        _put(path, db.serialize())
        db.close()
        return pd.DataFrame({"path": pd.Series([], dtype=object)})

    rows.groupBy("path").applyInPandas(one, "path string").write.format("noop").mode("overwrite").save()


def _write(spark: SparkSession, sf_dir: str, home: str, second: bool) -> None:
    """The transcripts of the first run, or what has changed until the second."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = c.groupBy("c").agg(F.max("turn").alias("last"))
    c = c.join(last, "c").withColumns({"session_id": F.format_string("conv-%06d", "c"), "role_json": json_string(F.col("role")), "text_json": json_string(F.col("text"))})
    base = F.concat(F.lit(f"{home}/u"), F.col("c") % USERS)
    # Even conversations lack their last turn in the first run.
    c = c.where("c % 2 = 0") if second else c.where("c % 2 = 1 OR turn < last OR c % 3 = 2")
    claude = F.format_string('{"type":"user","sessionId":"%s","message":{"role":%s,"content":[{"text":%s}]}}\n', "session_id", "role_json", "text_json")
    codex = F.format_string('{"type":"item","payload":{"type":"message","role":%s,"content":%s}}\n', "role_json", "text_json")
    lines = c.where("c % 3 < 2").select("c", "turn", "session_id", base.alias("base"), F.when(F.col("c") % 3 == 0, claude).otherwise(codex).alias("line"))
    told = lines.groupBy("c", "session_id", "base").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    start = F.when(F.col("c") % 3 == 1, F.format_string('{"type":"session_meta","payload":{"id":"%s","cwd":"/w"}}\n', "session_id")).otherwise("")
    place = F.when(F.col("c") % 3 == 0, F.lit("/.claude/projects/p/")).otherwise("/.codex/sessions/2024/")
    _write_files(told.select(F.concat("base", place, "session_id", F.lit(".jsonl")).alias("path"), F.concat(start, F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("content")))
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("c % 3 = 2")
    d = d.where("c % 10 <> 6" if second else "c % 10 <> 5")
    path = F.concat(F.lit(f"{home}/u"), F.col("c") % USERS, F.lit("/.local/share/opencode/opencode.db"), F.when((F.col("c") % USERS == USERS - 1) & F.lit(second), "broken").otherwise(""))
    _write_databases(d.select(path.alias("path"), F.format_string("conv-%06d", "c").alias("session_id"), F.when((F.col("c") % 2 == 0) & F.lit(second), 2).otherwise(1).alias("updated"), "turn", json_string(F.col("role")).alias("role_json"), json_string(F.col("text")).alias("text_json")))


def _second_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The report of the second of two runs, and where the table is."""
    home, target = shared_folder(spark, "home"), shared_folder(spark, "index")
    homes = [f"{home}/u{k}" for k in range(USERS)]
    _write(spark, sf_dir, home, second=False)
    index_home(spark, homes, target)
    _write(spark, sf_dir, home, second=True)
    return index_home(spark, homes, target), target


_SESSIONS_SQL = """s AS (SELECT conv_id AS c, count(*) FILTER (coalesce(text, '') <> '') AS n FROM conversations GROUP BY conv_id)"""


@register(
    f"""WITH {_SESSIONS_SQL}
SELECT CASE WHEN c % 3 = 0 THEN 'claude' ELSE 'codex' END AS tool, c % {USERS} AS user_no, printf('conv-%06d.jsonl', c) AS name, CASE WHEN c % 2 = 0 THEN 'read' ELSE 'unchanged' END AS outcome,
  CASE WHEN c % 2 = 0 THEN (n > 0)::BIGINT ELSE 0 END AS sessions, 0::BIGINT AS removed, CASE WHEN c % 2 = 0 THEN n ELSE 0 END AS messages FROM s WHERE c % 3 < 2
UNION ALL SELECT 'opencode', c % {USERS}, 'opencode.db', CASE WHEN c % {USERS} = {USERS - 1} THEN 'failed' ELSE 'read' END, count(*) FILTER (c % {USERS} < {USERS - 1} AND c % 10 <> 6 AND (c % 2 = 0 OR c % 10 = 5)),
  count(*) FILTER (c % {USERS} < {USERS - 1} AND c % 10 = 6), coalesce(sum(n) FILTER (c % {USERS} < {USERS - 1} AND c % 10 <> 6 AND (c % 2 = 0 OR c % 10 = 5)), 0)::BIGINT FROM s WHERE c % 3 = 2 GROUP BY c % {USERS}"""
)
def index_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run of the index reads: changed files, changed, new and removed sessions of databases, and a database that is broken by then."""
    report, _ = _second_run(spark, sf_dir)
    user = F.regexp_extract("source_path", "/u([0-9]+)/[.]", 1).cast("long")
    return report.select("tool", user.alias("user_no"), F.regexp_extract("source_path", "[^/]+$", 0).alias("name"), "outcome", "sessions", "removed", "messages")


@register(
    f"""SELECT CASE WHEN conv_id % 3 = 0 THEN 'claude' WHEN conv_id % 3 = 1 THEN 'codex' ELSE 'opencode' END AS tool, printf('conv-%06d', conv_id) AS session_id, count(*) AS messages,
  sum(length(text))::BIGINT AS chars FROM conversations WHERE coalesce(text, '') <> '' AND NOT (conv_id % 3 = 2 AND conv_id % {USERS} < {USERS - 1} AND conv_id % 10 = 6) AND NOT (conv_id % 3 = 2 AND conv_id % {USERS} = {USERS - 1} AND conv_id % 10 = 5)
GROUP BY conv_id"""
)
def indexed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after both runs: the broken database keeps the rows of the first."""
    _, target = _second_run(spark, sf_dir)
    found = messages_of(read_table(spark, target))
    return found.groupBy("tool", "session_id").agg(F.count("*").alias("messages"), F.sum(F.char_length("text")).alias("chars"))


# Documents as files: every third page is published first, then all that are approved, page by page in the order of ids. -------------------

_SLUG_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@register(
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN {_SLUG_SQL} ELSE 'page-' || (page_id // 2) END AS slug, page_id % 3 = 0 AS early, page_id % 5 <> 0 AS approved, html FROM pages),
q AS (SELECT *, slug <> '' AND length(slug) <= 64 AND html IS NOT NULL AS valid FROM p),
first AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) = 1 AS wins FROM q WHERE early AND approved AND valid),
second AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) = 1 AND slug NOT IN (SELECT slug FROM first) AS wins FROM q WHERE approved AND valid),
held AS (SELECT slug, md5(html) AS file_md5 FROM first WHERE wins UNION ALL SELECT slug, md5(html) FROM second WHERE wins)
SELECT q.page_id, q.slug, CASE WHEN NOT q.approved THEN 'not_approved' WHEN NOT q.valid THEN 'refused' WHEN second.wins THEN 'published' ELSE 'conflict' END AS outcome, file_md5
FROM q LEFT JOIN second USING (page_id) LEFT JOIN held ON held.slug = q.slug"""
)
def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of a second run, with what the file of each slug holds after it."""
    root = shared_folder(spark, "documents")
    slug = F.when(F.col("page_id") % 4 == 0, T.slugify(F.col("url"))).otherwise(F.concat(F.lit("page-"), F.floor(F.col("page_id") / 2)))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), slug.alias("slug"), F.col("html").alias("document"), "page_id")
    approved = pages.where("page_id % 5 <> 0")
    documents.publish_documents(approved.where("page_id % 3 = 0"), root)
    found = documents.publish_documents(approved, root)
    others = pages.where("page_id % 5 = 0").select("id", "slug", F.lit("not_approved").alias("outcome"))
    files = documents.read_documents(spark, root).select("slug", F.md5("document").alias("file_md5"))
    rows = found.select("id", "slug", "outcome").unionByName(others).join(files, "slug", "left")
    return rows.select(F.col("id").cast("long").alias("page_id"), "slug", "outcome", "file_md5")
