"""SimHash near-dedup by similarity: texts whose sets of five-word shingles have a Jaccard similarity of at least LEAST are linked.

This is operator 2 for a similarity instead of a radius. Two sets of similarity 0.8 differ in about 15 of 100 SimHash bits, so no
radius that pieces of a 64-bit fingerprint can search reaches them. Fingerprints here have 256 bits, and only texts that share one of
BANDS keys, each made of ROWS minima of hashes of the shingles (MinHash), meet in a tile: at similarity 0.8 a pair shares none with a
chance of (1 - 0.8 ** 5) ** 25, 5e-5, and less above it. In a tile, fingerprints are compared exactly, by numpy exclusive-or and bit
counts; pairs within RADIUS bits are verified by the exact similarity of their sets, and only verified links count. Pairs of sets of
fewer than SMALL shingles, whose fingerprints vary more, are all verified. Texts of the same words (A-Z folded) are one class.

How it scales: first, each class is compared once, by fingerprints and then by sets, with the one among those under its keys that shares keys with the most others, which
in a group of near copies is the text that they derive from; so a large group costs one comparison a member. Then only keys whose classes
are still in different parts go to tiles, in which pairs of one part are skipped. That grows with the square of a key's classes only
as far as they are near copies of none that many others are near to.

Defined results: texts without words, and null ones, are one class; of a component one row stays, the least by id (null last), text hash
and row number, whether or not ids are null or repeated; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, text_slices
from .components import connected_components
from .simhash import majority
from .tiles import TILE_KEYS, Spanning, close_rows, deal, groups

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5

#: Bits in which fingerprints of 256 may differ: at similarity 0.8 they differ in 39 on average, with a deviation of 6.
RADIUS = 66
SMALL = 64

#: Classes of a tile, and shingles of all its classes, at most (one larger text stands alone).
TILE, TILE_SHINGLES = 512, 4 << 20

_RNG = np.random.default_rng(77)
_MASKS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_FACTORS = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_WIDEN = _RNG.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words of a text, joined, and the sorted distinct hashes of their shingles; a shorter text is one shingle."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    n, joined = len(words), b" ".join(words)
    if n <= SHINGLE:
        return joined, np.array([xxhash.xxh3_64_intdigest(joined)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    return joined, np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    short = hashes.astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, ((short[None, at : at + 1024] ^ _MASKS) * _FACTORS).min(1), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(parts[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a set of hashes, as four numbers."""
    wide = hashes[:, None] * _WIDEN
    return majority((wide ^ (wide >> np.uint64(32))) * _WIDEN[::-1])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _signatures(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, keys, fps = [], [], [], []
            for texts in text_slices(batch.column("text")):
                for text in texts:
                    joined, hashes = shingles(text)
                    names.append(xxhash.xxh3_64_intdigest(joined))
                    sizes.append(len(hashes))
                    keys.append(band_keys(hashes))
                    fps.append(fingerprint(hashes).tobytes())
            name = pa.array(np.array(names, np.uint64).view(np.int64))
            columns = [*(batch.column(c) for c in ("id", "hash", "row")), name, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "row", "class", "size", "keys", "fp"])

    return rows.mapInArrow(run, "id long, hash long, row long, class long, size long, keys array<long>, fp binary")


def _sets(texts: DataFrame) -> DataFrame:
    """From (class, text): class and `hashes`, its sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(at, len(part)), pa.array([shingles(t)[1].tobytes() for t in part], pa.binary())], ["class", "hashes"])
                at += len(part)

    return texts.mapInArrow(run, "class long, hashes binary")


def _within(pairs: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b) of classes whose fingerprints differ in at most `radius` bits, and those of small sets."""

    @F.arrow_udf("long")
    def differing(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), -1) for x in (left, right))
        return pa.array(np.bitwise_count(a ^ b).sum(1, dtype=np.int64))

    of = lambda side: classes.select(F.col("class").alias(side), F.col("fp").alias(f"{side}_fp"), F.col("size").alias(f"{side}_size"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    small = F.greatest("a_size", "b_size") < SMALL
    return met.where(small | (differing("a_fp", "b_fp") <= radius)).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""

    @F.arrow_udf("double")
    def exact(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([similarity(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(left, right, strict=True)], pa.float64())

    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("a_hashes"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("b_hashes"))
    return pairs.join(left, "a").join(right, "b").where(exact("a_hashes", "b_hashes") >= least).select("a", "b")


def _tiled(rows: DataFrame, least: float, radius: int) -> DataFrame:
    """Links (a, b) that connect the similar ones of the dealt rows (class, part, fp, hashes), as far as their parts do not yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, TILE_KEYS):
            fp = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint64).reshape(group.num_rows, -1)
            side, name, part = (group.column(c).to_numpy() for c in ("side", "class", "part"))
            across = group.column("lo")[0] != group.column("hi")[0]
            order = np.lexsort((np.bitwise_count(fp).sum(1, dtype=int), side))
            fp, side, name, part = fp[order], side[order], name[order], part[order]
            raw = group.column("hashes")
            sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in order.tolist()]
            size = np.array([len(s) for s in sets])
            joined = Spanning(len(fp), part)
            left = int((side == 0).sum()) if across else 0
            small = np.flatnonzero(size < SMALL)
            for i, others in _candidates(fp, left, across, radius, small):
                near = joined.apart(i, others)
                near = near[np.minimum(size[near], size[i]) >= np.maximum(size[near], size[i]) * least - 1e-6]
                for j in near.tolist():
                    if joined.label[i] != joined.label[j] and similarity(sets[i], sets[j]) >= least:
                        joined.add(i, np.array([j]))
            if joined.kept:
                pairs = np.array(joined.kept)
                yield pa.RecordBatch.from_arrays([pa.array(name[pairs[:, 0]]), pa.array(name[pairs[:, 1]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _candidates(fp: np.ndarray, left: int, across: bool, radius: int, small: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield from close_rows(fp, left, across, radius)
    for i in small[small >= left].tolist():
        yield i, small[small < (left if across else i)]


def _comparable(one: Column, other: Column, least: float) -> Column:
    """Sets whose sizes differ more cannot be similar enough."""
    return F.least(one, other) >= F.greatest(one, other) * least - 1e-6


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The documents without all but one row of each component of near copies, with all their columns."""
    row = fresh(docs, "row_number")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marked = stage(_signatures(numbered.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(row).alias("row"), F.col(text_col).alias("text"))), "signatures")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash", "row")
    classes = stage(marked.groupBy("class").agg(F.min(order).alias("first"), *[F.any_value(c).alias(c) for c in ("size", "keys", "fp")]), "classes")
    banded = classes.select("class", "size", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(banded.join(shared, "key"), "met")
    known = met.groupBy("class").agg(F.sum("n").alias("known"))
    ranked = stage(met.join(known, "class").select("key", "class", "size", "known"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("known", "class", "size")).alias("hub"))
    stars = ranked.join(hubs, "key").where((F.col("class") != F.col("hub.class")) & _comparable(F.col("size"), F.col("hub.size"), least))
    # One comparison a class: with the best known of its hubs. What that leaves apart is for the tiles.
    stars = _within(stars.groupBy("class").agg(F.max("hub").alias("hub")).select(F.col("hub.class").alias("a"), F.col("class").alias("b")), classes, radius)
    nodes = known.join(classes.select("class", F.col("first.row").alias("row"), "fp"), "class").select("class", "row", "fp")
    texts = nodes.join(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text")), "row").select("class", "text")
    sets = stage(_sets(texts), "shingle-sets")
    links = stage(_similar(stars, sets, least), "star-links")
    parts = connected_components(links)
    parted = met.join(parts, met["class"] == parts["node"], "left").select("key", "class", "size", F.coalesce("component", "class").alias("part"))
    parted = stage(parted, "parted")
    open_ = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.sum("size").alias("shingles")).where("low <> high")
    open_ = stage(open_.select("key", F.ceil(F.greatest(F.col("n") / tile, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("parts")), "open-keys")
    rows = parted.join(open_.select("key"), "key").join(classes.select("class", "fp"), "class").join(sets, "class").select("key", "class", "part", "fp", "hashes")
    links = links.unionAll(stage(_tiled(deal(rows, open_.where("parts > 1"), F.col("class")), least, radius), "tile-links"))
    rooted = connected_components(links)
    named = classes.join(rooted, classes["class"] == rooted["node"], "left").select("class", "first", F.coalesce("component", "class").alias("root"))
    kept = stage(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "kept")
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
