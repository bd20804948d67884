"""Tiles: groups of rows that are compared with each other in one task, and what is found in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_KEYS = ["key", "lo", "hi"]


def deal(rows: DataFrame, parts: DataFrame, by: Column) -> DataFrame:
    """Rows sorted by pairs of tiles (key, lo, hi), `side` telling which of the two a row is in.

    `parts` (key, parts) says into how many tiles the rows of a key go, by a hash of `by`; keys that it lacks are one tile.
    """
    n = F.coalesce("parts", F.lit(1)).cast("long")
    own = rows.join(parts, "key", "left").withColumn("own", F.pmod(F.xxhash64(by), n))
    met = own.select(*rows.columns, "own", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    pair = met.select(*rows.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    return pair.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal integer keys, from batches sorted by them; groups of one row are left out."""
    held: list[pa.RecordBatch] = []
    held_key: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        ends = np.append(starts[1:], batch.num_rows)
        if held and tuple(c[0] for c in columns) != held_key:
            if sum(b.num_rows for b in held) > 1:
                yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if held:
                yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
                held = []
            elif end - start > 1:
                yield pa.Table.from_batches([batch.slice(start, end - start)])
        held.append(batch.slice(int(starts[-1])))
        held_key = tuple(c[-1] for c in columns)
    if held and sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


def close_rows(fp: np.ndarray, left: int, across: bool, radius: int, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Rows with earlier rows (or, if `across`, with rows before `left`) whose fingerprints differ in at most `radius` bits.

    `fp` has some 64-bit words a row; rows are in the order of their numbers of one bits (on either side of `left`). Those whose
    numbers differ by more than the radius are skipped.
    """
    ones = np.bitwise_count(fp).sum(1, dtype=np.int64)
    for start in range(left, len(fp), block):
        stop = min(start + block, len(fp))
        upto = left if across else stop
        low = int(np.searchsorted(ones[:upto], ones[start] - radius, "left"))
        high = int(np.searchsorted(ones[:upto], ones[stop - 1] + radius, "right"))
        if high <= low:
            continue
        differing = np.zeros((stop - start, high - low), np.uint16)
        for word in range(fp.shape[1]):
            differing += np.bitwise_count(fp[start:stop, word, None] ^ fp[None, low:high, word])
        found = differing <= radius
        if not across:
            found &= np.arange(low, high)[None, :] < np.arange(start, stop)[:, None]
        for r in np.flatnonzero(found.any(1)).tolist():
            yield start + r, low + np.flatnonzero(found[r])


class Spanning:
    """Of the pairs that it is told, keeps those that join two parts not joined before; places are numbers below n."""

    def __init__(self, n: int, parts: np.ndarray | None = None) -> None:
        self.label = np.arange(n) if parts is None else np.unique(parts, return_inverse=True)[1]
        self.kept: list[tuple[int, int]] = []

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that are in another part than i."""
        return others[self.label[others] != self.label[i]]

    def add(self, i: int, others: np.ndarray) -> None:
        """Pairs of i with each of others."""
        roots, at = np.unique(self.label[others], return_index=True)
        for root, k in zip(roots.tolist(), at.tolist(), strict=True):
            mine = self.label[i]
            if self.label[others[k]] != mine:
                self.label[self.label == root] = mine
                self.kept.append((i, int(others[k])))
