"""Finding the transcripts of every tool below a home folder, their signatures, and reading all of them as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import signatures
from ..plans.tables import TOOLS
from .jsonl import READERS, read_grok
from .opencode import read_opencode

# Where the tools keep their transcripts, below the home folder.
PLACES = {
    "opencode": r"/\.local/share/opencode/opencode\.db\z",
    "grok": r"/\.grok/sessions/(?:.*/)?chat_history\.jsonl\z",
    "codex": r"/\.codex/sessions/(?:.*/)?[^/]*\.jsonl\z",
    "kimi-code": r"/\.kimi-code/sessions/(?:.*/)?session_[^/]*/agents/[^/]+/wire\.jsonl\z",
    "claude": r"/\.claude/projects/[^/]+/[^/]*\.jsonl\z",
}


# The folders below the home folder in which these lie. Spark's listings skip names with a leading dot, so they are named.
ROOTS = [".local/share/opencode", ".grok/sessions", ".codex/sessions", ".kimi-code/sessions", ".claude/projects"]


def listing(spark: SparkSession, home: str | list[str]) -> DataFrame:
    """path, mtime (seconds) and size of all files in the tools' folders of one or more homes; contents are not read, folders may be missing."""
    jvm = spark.sparkContext._jvm
    there = []
    for root in [f"{h.rstrip('/')}/{r}" for h in ([home] if isinstance(home, str) else home) for r in ROOTS]:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there.append(path.toString())
    if not there:
        return spark.createDataFrame([], "path string, mtime double, size long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    return files.select("path", (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"), F.col("length").alias("size"))


def tool_of(path: Column) -> Column:
    tool = F.lit(None).cast("string")
    for name in TOOLS:
        tool = F.coalesce(tool, F.when(path.rlike(PLACES[name]), name))
    return tool


def discover(files: DataFrame) -> DataFrame:
    """tool and source_path of the transcripts in a listing, tools in their fixed order, paths sorted."""
    found = files.select(tool_of(F.col("path")).alias("tool"), F.col("path").alias("source_path")).where("tool IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, TOOLS)), F.col("tool"))
    return found.orderBy(rank, "source_path")


def sources(spark: SparkSession, home: str | list[str]) -> DataFrame:
    """The transcripts below a home folder with their signatures: tool, source_path, mtime and size."""
    files = listing(spark, home)
    return signatures(files, discover(files))


def grok_summaries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """folder, cwd, title and created from summary.json files, from the top level or from `info`; empty where unreadable."""
    raw = spark.read.text(paths, wholetext=True, pathGlobFilter="summary.json", recursiveFileLookup=True)
    v = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1).alias("folder"), F.try_parse_json("value").alias("v"))

    def first(*paths: str) -> Column:
        found = [F.try_variant_get("v", f"$.{p}", "string") for p in paths]
        return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))

    return v.select(
        "folder", first("info.cwd", "cwd").alias("cwd"), first("generated_title", "info.generated_title").alias("title"), first("created_at", "info.created_at").alias("created")
    )


def read_all(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The messages of all sources (tool, source_path), whatever their tool. The list of paths is as long as there are files."""
    by_tool: dict[str, list[str]] = {}
    for row in found.select("tool", "source_path").toLocalIterator():
        by_tool.setdefault(row.tool, []).append(row.source_path)
    parts = []
    for tool in [t for t in TOOLS if t in by_tool]:
        paths = by_tool[tool]
        if tool == "opencode":
            parts += [read_opencode(spark, p.removeprefix("file:")) for p in paths]
        elif tool == "grok":
            parts.append(read_grok(spark, paths, grok_summaries(spark, sorted({p.rpartition("/")[0] for p in paths}))))
        else:
            parts.append(READERS[tool](spark, paths))
    if not parts:
        raise ValueError("no transcripts found")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
