"""Readers of session transcripts in JSON lines: one per tool, all giving the same message rows.

Lines are read with their place in the file, filtered by a substring before they are parsed, and parsed as variants; lines that are
no JSON objects are dropped. Values that later lines inherit are filled forward along the file. Long files are read by several tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.regexes import UUID
from ..functions.timestamps import timestamp_epoch
from ..operators.windows import fill_forward

#: Files to be read for each folder that holds them, from which on folders are listed.
FILES_A_FOLDER = 4

COLUMNS = ["tool", "session_id", "cwd", "title", "ts", "role", "text", "source_path", "line"]


def plain_path(path: Column) -> Column:
    """A path as listings write it, from a URI."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def _opened(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The lines of files. Spark takes a task for each path to be listed, so of many files as listings write them their folders are listed, and other files are left out."""
    read = lambda p: spark.read.text(p, lineSep="\n", recursiveFileLookup=True)
    listed = isinstance(paths, list) and all(re.match("file:/[^/]|(?!file:)[a-z0-9]+://", p) for p in paths)
    folders = {p.rpartition("/")[0] for p in paths} if listed else set()
    above = lambda folder: any(folder[: m.start()] in folders for m in re.finditer("/", folder))
    folders = sorted(f for f in folders if not above(f))
    if not listed or len(paths) < FILES_A_FOLDER * len(folders):
        return read(paths)
    return read(folders).where(plain_path(F.col("_metadata.file_path")).isin(paths))


def lines(spark: SparkSession, paths: list[str] | str, hint: str) -> DataFrame:
    """source_path, line and v, the parsed line, of the lines that contain `hint`.

    `line` is text that sorts as the lines of a file do: the start of a line's block in the file, then its row in the task that reads
    the block. It says nothing else, and changes where files are split elsewhere.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.concat(F.lpad(F.hex("_metadata.file_block_start"), 12, "0"), F.lpad(F.hex(row), 9, "0"))
    each = _opened(spark, paths).select(F.col("_metadata.file_path").alias("source_path"), line.alias("line"), F.col("value").alias("raw"))
    parsed = each.select("source_path", "line", F.when(F.col("raw").contains(hint), F.try_parse_json("raw")).alias("v"))
    return parsed.where(F.schema_of_variant("v").startswith("OBJECT"))


def field(path: str, v: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def first_of(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


#: Fixed value: levels beyond which JSON texts are not parsed.
LEVELS = 1000


def variant_text(v: Column) -> Column:
    """The text of a message's content: a string; an object's text or, without one, that of its content; the texts of an array, a line each.

    In an array only strings and objects count; empty texts are left out. Content is opened level by level in place, all items of a level
    at once, until only strings are left, however deep that is.
    """
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    of_kind = lambda x, name: kind(x).startswith(name)
    none = F.array().cast("array<variant>")

    def opened(x: Column) -> Column:
        """The items of a content: of an array those that are no arrays, anything else by itself."""
        return F.when(of_kind(x, "ARRAY"), F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda y: ~of_kind(y, "ARRAY"))).when(x.isNull(), none).otherwise(F.array(x))

    def one(x: Column) -> Column:
        own = F.try_variant_get(x, "$.text", "variant")
        return F.when(of_kind(x, "OBJECT"), F.when(of_kind(own, "STRING"), F.array(own)).otherwise(opened(F.try_variant_get(x, "$.content", "variant")))).when(of_kind(x, "STRING"), F.array(x)).otherwise(none)

    level = lambda items: F.flatten(F.transform(items, one))
    is_open = lambda items: F.exists(items, lambda x: of_kind(x, "OBJECT"))
    rest = lambda items: F.aggregate(F.sequence(F.lit(1), F.when(is_open(items), LEVELS).otherwise(1)), items, lambda now, _: F.when(is_open(now), level(now)).otherwise(now))
    strings = T.let(level(opened(v)), rest)
    return F.array_join(F.filter(F.transform(strings, lambda x: F.when(of_kind(x, "STRING"), F.try_variant_get(x, "$", "string"))), lambda t: t != ""), "\n")


def content_text(path: str) -> Column:
    """The text of the content at a path of the line's variant; empty if there is none."""
    return F.coalesce(variant_text(F.try_variant_get("v", f"$.{path}", "variant")), F.lit(""))


def file_session_id(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)
    return first_of(F.regexp_extract(name, UUID, 0), name)


def _records(rows: DataFrame, tool: str) -> DataFrame:
    out = rows.where((F.col("text") != "") & (F.trim("session_id") != "")).withColumn("tool", F.lit(tool))
    return out.withColumn("role", T.normalize_role(F.col("role"), F.col("text"))).withColumn("ts", timestamp_epoch(F.col("ts"))).withColumn("session_id", F.trim("session_id")).select(*COLUMNS)


def read_codex(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    rows = lines(spark, paths, '"type"').withColumn("type", field("type")).where("type <> ''")
    meta = F.col("type") == "session_meta"
    rows = rows.withColumns({"session_id": F.when(meta, field("payload.id")), "cwd": F.when(meta, field("payload.cwd")), "since": F.when(meta, field("payload.timestamp"))})
    rows = fill_forward(rows, ["source_path"], ["line"], ["session_id", "cwd", "since"])
    said = rows.where((field("payload.type") == "message") & (F.col("type") != "session_meta"))
    return _records(
        said.select("source_path", "line", first_of(F.col("session_id"), file_session_id(F.col("source_path"))).alias("session_id"), F.coalesce("cwd", F.lit("")).alias("cwd"), F.lit("").alias("title"), first_of(field("timestamp"), field("payload.timestamp"), F.col("since")).alias("ts"), field("payload.role").alias("role"), content_text("payload.content").alias("text")),
        "codex",
    )


def read_claude(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    rows = lines(spark, paths, '"type"').withColumn("type", field("type")).where(F.col("type").isin("user", "assistant"))
    return _records(
        rows.select("source_path", "line", first_of(field("sessionId"), field("session_id"), file_session_id(F.col("source_path"))).alias("session_id"), first_of(field("cwd"), field("directory")).alias("cwd"), field("title").alias("title"), first_of(field("timestamp"), field("message.timestamp")).alias("ts"), first_of(field("message.role"), F.col("type")).alias("role"), content_text("message.content").alias("text")),
        "claude",
    )


def read_grok(spark: SparkSession, paths: list[str] | str, summaries: DataFrame | None = None) -> DataFrame:
    """Sidecar summaries are (folder, cwd, title, created), one row per session folder."""
    rows = lines(spark, paths, '"type"').withColumn("type", field("type")).where(F.col("type").isin("user", "assistant"))
    folder, parent = F.regexp_extract("source_path", r"^(.*)/[^/]+$", 1), F.regexp_extract("source_path", r"([^/]+)/[^/]+/[^/]+$", 1)
    rows = rows.withColumn("folder", folder).withColumn("place", F.try_url_decode(F.replace(parent, F.lit("+"), F.lit("%2B"))))
    if summaries is None:
        rows = rows.withColumns({"side_cwd": F.lit(""), "side_title": F.lit(""), "side_created": F.lit("")})
    else:
        side = summaries.select("folder", F.col("cwd").alias("side_cwd"), F.col("title").alias("side_title"), F.col("created").alias("side_created"))
        rows = rows.join(side, "folder", "left")
    return _records(
        rows.select("source_path", "line", F.regexp_extract("folder", r"([^/]+)$", 1).alias("session_id"), first_of(F.col("side_cwd"), F.coalesce("place", F.lit(""))).alias("cwd"), F.coalesce("side_title", F.lit("")).alias("title"), first_of(field("timestamp"), F.col("side_created")).alias("ts"), F.col("type").alias("role"), content_text("content").alias("text")),
        "grok",
    )


def read_kimi(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    rows = lines(spark, paths, "context.append_").withColumn("type", field("type"))
    message, loop = F.col("type") == "context.append_message", F.col("type") == "context.append_loop_event"
    html = lambda c: F.replace(F.replace(F.replace(c, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))
    as_json = lambda path: html(F.to_json(F.try_variant_get("v", f"$.{path}", "variant")))
    kind = field("event.type")
    part = F.when(field("event.part.type") == "text", field("event.part.text"))
    call = F.concat_ws(" ", F.lit("tool.call"), field("event.name"), as_json("event.args"))
    result = F.concat_ws(" ", F.lit("tool.result"), field("event.toolCallId"), as_json("event.result"))
    event = F.when(kind == "content.part", part).when(kind == "tool.call", call).when(kind == "tool.result", result)
    origin = field("message.origin.kind")
    role = F.when(message, F.when(origin == "user", "user").when(origin != "", "system").otherwise(field("message.role"))).otherwise("assistant")
    text = F.when(message, content_text("message.content")).when(loop, F.coalesce(event, F.lit("")))
    told = F.regexp_extract(text, r"(?:Workspace Path|工作区路径):\s*(.+)", 1)
    rows = rows.withColumns({"said": text, "speaker": role, "cwd": first_of(field("message.cwd"), F.trim(told))})
    rows = fill_forward(rows, ["source_path"], ["line"], ["cwd"])
    session = F.regexp_extract("source_path", r"(session_[^/]+)/agents/", 1)
    return _records(rows.select("source_path", "line", first_of(session, file_session_id(F.col("source_path"))).alias("session_id"), F.coalesce("cwd", F.lit("")).alias("cwd"), F.lit("").alias("title"), field("time").alias("ts"), F.col("speaker").alias("role"), F.col("said").alias("text")), "kimi-code")


READERS = {"codex": read_codex, "claude": read_claude, "grok": read_grok, "kimi-code": read_kimi}
