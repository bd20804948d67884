"""The message table, from the driver's conversations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tools whose transcripts are read, in order.
TOOLS = ["opencode", "grok", "codex", "kimi-code", "claude"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir; only in local mode, where it may be unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='threadlens-')}"
    return f"{base.rstrip('/')}/threadlens/{name}-{uuid.uuid4().hex}"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tool, session_id, source_path, cwd, ts, role, text; a session has two sources."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("conv_id") % 5 + 1).cast("int")).alias("tool"),
        F.format_string("conv-%06d", "conv_id").alias("session_id"),
        F.concat_ws("/", F.lit("/src"), "conv_id", F.col("turn") % 2).alias("source_path"),
        F.concat(F.lit("/work/p"), F.col("conv_id") % 7).alias("cwd"),
        (F.lit(1704067200.0) + F.col("conv_id") * 600 + F.col("turn") * 10).alias("ts"),
        "role",
        "text",
    )


#: The same for DuckDB, as the start of a query.
MESSAGES_SQL = """m AS (
  SELECT conv_id * 1000 + turn AS id, ['opencode', 'grok', 'codex', 'kimi-code', 'claude'][(conv_id % 5 + 1)::INT] AS tool,
    printf('conv-%06d', conv_id) AS session_id, '/src/' || conv_id || '/' || (turn % 2) AS source_path, '/work/p' || (conv_id % 7) AS cwd,
    1704067200.0::DOUBLE + conv_id * 600 + turn * 10 AS ts, role, text
  FROM conversations)"""
