"""Sharding by a permutation-filled lookup table, with DataFrame operations only.

Each shard has its own order of preference over the slots of a table of prime size: it starts at an offset and goes on by a skip,
both from a hash of its name, so the order visits every slot. The shards take turns; each claims the first slot of its order that is
still free, until all are claimed. Shards get equal shares to within one slot, and when a shard is added or removed few slots move.

A row's key is hashed to a slot, and the slot's shard is looked up in a broadcast copy of the table. Its size is fixed by
`table_size` (at most MAX_TABLE slots), whatever the data.

Defined results: a null key is placed as the empty string; equal keys go to the same shard, so a key that many rows share should be
joined with a row id; extra columns are kept, and clashing names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The largest lookup table that is broadcast: under 2 MB.
MAX_TABLE = 1 << 17


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], table_size: int) -> tuple[int, ...]:
    """The shard (by its place in `shards`) of every slot."""
    if not _is_prime(table_size) or table_size > MAX_TABLE:
        raise ValueError(f"table_size must be a prime of at most {MAX_TABLE}: {table_size}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct, at least one and at most table_size")
    starts, skips = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        starts.append(int.from_bytes(digest[:8], "big") % table_size)
        skips.append(int.from_bytes(digest[8:], "big") % (table_size - 1) + 1 if table_size > 2 else 1)
    owner = [-1] * table_size
    turn = 0
    for _ in range(table_size):
        slot = starts[turn]
        while owner[slot] >= 0:
            slot = (slot + skips[turn]) % table_size
        owner[slot] = turn
        starts[turn] = (slot + skips[turn]) % table_size
        turn = (turn + 1) % len(shards)
    return tuple(owner)


def slot_of(key: Column, table_size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % table_size).cast("int")


def assign_shards(docs: DataFrame, shards: Sequence[str], *, key_col: str = "doc_id", table_size: int = 65537) -> DataFrame:
    """Adds `slot` and `shard` (a place in `shards`) to every row."""
    owner = lookup_table(tuple(shards), table_size)
    lookup_slot, lookup_shard = fresh(docs, "lookup_slot"), fresh(docs, "lookup_shard")
    slots = docs.sparkSession.range(table_size, numPartitions=1).select(
        F.col("id").cast("int").alias(lookup_slot),
        F.element_at(F.split(F.lit(",".join(map(str, owner))), ","), (F.col("id") + 1).cast("int")).cast("int").alias(lookup_shard),
    )
    placed = docs.withColumn("slot", slot_of(F.col(key_col), table_size))
    return placed.join(F.broadcast(slots), F.col("slot") == F.col(lookup_slot)).withColumn("shard", F.col(lookup_shard)).drop(lookup_slot, lookup_shard)


def write_shards(docs: DataFrame, shards: Sequence[str], path: str, *, key_col: str = "doc_id", table_size: int = 65537) -> None:
    """One folder for each shard; a shard is written by the task that holds it, in files of bounded size."""
    placed = assign_shards(docs, shards, key_col=key_col, table_size=table_size)
    placed.repartition("shard", F.col("slot") % 8).write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)


def shard_sql(shards: Sequence[str], table_size: int = 65537) -> str:
    owner = ",".join(map(str, lookup_table(tuple(shards), table_size)))
    return f"""
WITH placed AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {table_size})::INT AS slot FROM documents),
slots AS (SELECT unnest([{owner}]) AS shard, unnest(range({table_size})) AS slot)
SELECT doc_id, slot, shard::INT AS shard FROM placed JOIN slots USING (slot)
"""
