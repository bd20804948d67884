"""Saved output of `git log --no-merges --name-only --no-renames --format=%x1e%H%x1f%h%x1f%s%x1f%an%x1f%aI`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, short_hash, subject, author, time and the sorted distinct paths of each commit; a damaged record is left out."""
    lines = spark.read.option("lineSep", "\x1e").text(path).select(F.split(F.regexp_replace("value", r"^[\r\n]+|[\r\n]+\z", ""), "\r?\n").alias("lines"))
    fields = F.split(F.col("lines")[0], "\x1f")
    paths = F.array_sort(F.array_distinct(F.filter(F.transform(F.slice("lines", F.lit(2), F.size("lines")), T.trim_white), lambda p: p != "")))
    good = lines.withColumn("f", fields).where((F.size("f") == 5) & (F.trim(F.col("f")[0]) != ""))
    names = ["hash", "short_hash", "subject", "author", "time"]
    return good.select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)], paths.alias("paths"))
