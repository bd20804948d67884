"""SimHash near-dedup: 64-bit fingerprints of four-word shingles, linked at a Hamming distance of at most RADIUS.

Fingerprints are compared exactly, in tiles: numpy exclusive-or and bit counts of the rows of one tile against another's. Tile pairs
whose numbers of one bits differ by more than the radius are skipped, as such rows differ in more bits than that.

Comparing all tiles with all others would take the square of the corpus. The 64 bits are therefore cut into five pieces: two
fingerprints within the radius agree in at least one of them, so only fingerprints that agree in a piece (12 or 13 bits) meet. That
loses no pair. A piece's value that more than TILE rows share is split further: the bits outside the piece are cut into five parts of
their own, and only rows that agree in one of these too (some 23 bits together) meet, which loses no pair either.

Equal fingerprints are one row from the start. What more than TILE rows share even then is dealt to tiles by bit count and, within
a bit count, by hash; each pair of tiles is then a unit of work of its own. A tile pair emits only links that join parts of it not
joined before, and components (components.py) are found over all of these.

Defined results: a null text or one without words has fingerprint zero, which is linked like any other; a null id takes part, but is
no component's name unless all ids of the component are null; repeated rows are in one component; extra columns are ignored by
near_duplicates() and kept by keep_one(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_slices
from .components import connected_components
from .tiles import Spanning, close_rows, groups

SHINGLE = 4
SEED = 42
RADIUS = 4

#: Rows of a tile.
TILE = 2048


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    return int(majority(np.array(hashes, np.uint64)[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit hashes, the number whose bits are set in over half of the rows."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `id` and `fp`, the fingerprint as a signed number."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for part in text_slices(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def pieces(blocks: int) -> list[int]:
    """Masks of the 64 bits cut into `blocks` pieces of nearly equal width."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def parts_outside(mask: int, n: int) -> list[int]:
    """Masks of the bits outside `mask`, cut into n parts of nearly equal width."""
    bits = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def close_links(fps: DataFrame, *, radius: int = RADIUS, tile: int = TILE, blocks: int = 5) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` with a path of steps of at most `radius` bits."""
    chosen = [sum(c) for c in combinations(pieces(blocks), blocks - radius)]
    first = fps.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in chosen])).alias("choice", "bits"))
    first = first.select("fp", "ones", "choice", F.xxhash64("choice", "bits").alias("key"))
    hot = stage(first.groupBy("key").count().where(F.col("count") > tile).select("key", F.lit(True).alias("hot")), "hot-keys")
    first = first.join(hot, "key", "left")
    # The bits outside a choice again differ in at most `radius` places, so two near rows agree in one of radius + 1 parts of them.
    outside = F.array(*[F.array(*[F.lit(_signed(m)) for m in parts_outside(c, radius + 1)]) for c in chosen])
    second = first.where("hot").select("fp", "ones", "key", F.posexplode(F.get(outside, F.col("choice"))).alias("part", "mask"))
    second = second.select("fp", "ones", F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    keyed = first.where("hot IS NULL").select("fp", "ones", "key").unionAll(second)
    by_ones = second.groupBy("key", "ones").count()
    large = stage(
        by_ones.groupBy("key").agg(F.sum("count").alias("n"), F.collect_list(F.struct("ones", F.ceil(F.col("count") / tile).cast("int").alias("parts"))).alias("counts")).where(F.col("n") > tile).select("key", "counts"),
        "large-keys",
    )
    rows = keyed.join(large, "key", "left")
    small = rows.where("counts IS NULL").select("key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("side"), "fp")
    own_parts = F.filter("counts", lambda c: c["ones"] == F.col("ones"))[0]["parts"]
    own = F.col("ones").cast("long") * F.lit(1 << 32) + F.pmod(F.hash("fp"), own_parts)
    near = F.filter("counts", lambda c: F.abs(c["ones"] - F.col("ones")) <= radius)
    partners = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda p: c["ones"].cast("long") * F.lit(1 << 32) + p)))
    dealt = rows.where("counts IS NOT NULL").select("key", "fp", own.alias("own"), F.explode(partners).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "lo", "hi"]):
            fp = group.column("fp").to_numpy().view(np.uint64)
            side = group.column("side").to_numpy()
            across = group.column("lo")[0] != group.column("hi")[0]
            order = np.lexsort((np.bitwise_count(fp), side))
            fp, side = fp[order], side[order]
            joined = Spanning(len(fp))
            for i, others in close_rows(fp[:, None], int((side == 0).sum()) if across else 0, across, radius):
                joined.add(i, others)
            if joined.kept:
                pairs = np.array(joined.kept)
                signed = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], ["a", "b"])

    work = small.unionAll(dealt).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return work.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: `id`, `fp` and `component`, the smallest id reachable over links."""
    marked = stage(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    linked = connected_components(close_links(classes, radius=radius, blocks=radius + 1))
    rooted = stage(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component")), "least")
    named = stage(rooted.join(least, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents without all but one of each component, with all their columns: the one with the smallest id stays.

    Documents without an id, or with one that another document has, stay or go with that id.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, radius=radius)
    gone = stage(found.where("id <> component").select(F.col("id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
