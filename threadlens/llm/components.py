"""Distributed connected components, by alternating large-star and small-star steps.

Each step hangs the neighbours of a node on the smallest of them; after a logarithmic number of steps every component is a star
around its smallest node. Minima are pre-aggregated, so a node with very many links costs no task more than others, and its rows in
the joins are split by adaptive execution. Each step is written to the shared folder, so lineage stays short; only a count and a
checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b), both long: `node` and `component` (the smallest node reachable) of every node with a link to another."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = stage(links.where("a <> b").select(u.alias("u"), v.alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large-star")
        least = stage(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        hung = large.join(least, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = stage(hung.unionAll(least.select("u", F.col("low").alias("v"))).distinct(), "small-star")
        for done in (now, low, large, least):
            drop_stage(done)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s")).first()
    return row.n, int(row.s)
