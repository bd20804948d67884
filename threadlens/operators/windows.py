"""Ordered analytics inside a session. A session is ordered by (ts, id); its rows meet in one task, as order needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0.0)), "id")


def place(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The place of each message in its session, from 1, as `at`."""
    return messages.withColumn("at", F.row_number().over(_order(keys)))


def turn_index(messages: DataFrame, keys: list[str]) -> DataFrame:
    """User turns, numbered from 0."""
    users = messages.where(F.col("role") == "user")
    return users.withColumn("turn_no", F.row_number().over(_order(keys)) - 1)


def turn_windows(messages: DataFrame, keys: list[str], size: int = 48, overlap: int = 1) -> DataFrame:
    """Windows of at most `size` user turns that overlap by `overlap`: window, its first turn and its number of turns."""
    step = size - overlap
    n = messages.where(F.col("role") == "user").groupBy(*keys).agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("long")
    w = n.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    return w.select(*keys, "window", (F.col("window") * step).alias("first_turn"), F.least(F.lit(size), F.col("n") - F.col("window") * step).cast("long").alias("turns"))


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Empty values take the last value before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})


def running_budget(messages: DataFrame, keys: list[str], per_message: int = 1200, total: int = 6000) -> DataFrame:
    """How many characters of each message fit when messages share a running budget."""
    size = F.least(F.length("text"), F.lit(per_message))
    before = F.coalesce(F.sum(size).over(_order(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return messages.withColumn("chars", F.greatest(F.lit(0), F.least(size, F.lit(total) - before)).cast("long"))


def fair_share(messages: DataFrame, keys: list[str], total: int = 6000) -> DataFrame:
    """Equal parts of a budget for the messages of a session; what does not divide goes to the first ones."""
    n = F.count("*").over(Window.partitionBy(*keys))
    share = F.floor(F.lit(total) / n) + F.when(F.row_number().over(_order(keys)) <= total % n, 1).otherwise(0)
    return messages.withColumn("chars", F.least(share, F.length("text")).cast("long"))


def split_at(rows: DataFrame, keys: list[str], is_new: str) -> DataFrame:
    """Numbers the segments that start at the rows whose flag `is_new` is set; rows before the first are dropped."""
    segment = F.sum(F.col(is_new).cast("int")).over(_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("segment", segment).where("segment >= 1")


def instructions(messages: DataFrame, keys: list[str], parts: int = 3, chars: int = 800) -> DataFrame:
    """The first assistant texts of a session, clipped and joined."""
    m = messages.where((F.col("role") == "assistant") & (T.trim_white(F.col("text")) != "")).withColumn("nth", F.row_number().over(_order(keys))).where(F.col("nth") <= parts)
    body = F.struct("nth", T.clip(T.trim_white(F.col("text")), chars).alias("body"))
    return m.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda b: b["body"]), "\n\n").alias("instructions"))
