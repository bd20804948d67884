"""Commits that touch the paths a decision is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(T.trim_white(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def prefixes(path: Column) -> Column:
    """a/b/c as a, a/b and a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_overlaps(wanted: DataFrame, commits: DataFrame) -> DataFrame:
    """Pairs (decision_id, hash) of rows (decision_id, path) and (hash, path) of which one path is the other or lies below it.

    Each side's paths meet the other side's prefixes in a join on equality, so no pair is formed that does not overlap.
    """
    w = wanted.select("decision_id", normal_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    c = commits.select("hash", normal_path(F.col("path")).alias("path")).where("path <> ''").distinct()
    above = w.join(c.select("hash", F.explode(prefixes(F.col("path"))).alias("path")), "path")
    below = w.select("decision_id", F.explode(prefixes(F.col("path"))).alias("path")).join(c, "path")
    return above.select("decision_id", "hash").unionByName(below.select("decision_id", "hash")).distinct()


def select_commits(commits: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests (asked) with the hash of the commit whose full or short hash it is; null where there is none."""
    names = commits.select("hash", F.explode(F.array_distinct(F.array("hash", "short_hash"))).alias("asked")).where("asked <> ''").distinct()
    return asked.withColumn("asked", F.trim("asked")).distinct().join(names, "asked", "left")
