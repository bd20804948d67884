"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors whose sign patterns under `bits` random hyperplanes agree in at least one of `tables` tables are compared by their cosine in
double precision. `bits` follows from the number of vectors, so that buckets hold some hundreds of vectors, and `tables` from the
chance of missing a pair at the threshold (MISS, at most one in ten thousand).

Equal vectors are one row with a count from the start. A row of a table carries the vector as it is stored (four bytes a component
for float arrays) and its sign patterns in as few bytes as they need. A bucket of more than TILE vectors is dealt to tiles by hash,
and each pair of tiles is a unit of work. Links are counted where they are found; a pair that met in an earlier table already is not
counted again, which its sign patterns tell. Pairs themselves are never emitted, only counts and the links that join parts of a tile.

Vectors are scaled by a power of two before products are taken, so no square over- or underflows.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors of another length than their
partner's, link with nothing; repeated rows are other vectors that link, and so are rows that share an id; rows without an id are
counted and linked like any other, but name no component (null where it has no other rows); extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import stage
from .components import connected_components
from .tiles import TILE_KEYS, Spanning, deal, groups

COSINE = 0.95
MISS = 1e-4
TILE = 4096
BUCKET = 1024
SEED = 20


def plan_tables(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """bits and tables for n vectors."""
    bits = min(24, max(6, math.ceil(math.log2(max(1, n) / BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _matrix(raws: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """The vectors as doubles, each scaled by a power of two to a largest component of about one."""
    v = np.frombuffer(b"".join(raws.to_pylist()), kind).astype(float).reshape(len(raws), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def _digests(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """id, digest (null for vectors that link with nothing) and the bytes of the vector."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes | None] = []
            raws: list[bytes | None] = []
            for value in batch.column("v"):
                v = value.values.to_numpy(zero_copy_only=False) if value.is_valid and not value.values.null_count else np.zeros(0)
                good = len(v) and np.isfinite(v).all() and v.any()
                raw = (v + v.dtype.type(0)).astype(kind).tobytes() if good else None
                raws.append(raw)
                digests.append(None if raw is None else xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["id", "digest", "raw"])

    return rows.mapInArrow(run, "id long, digest binary, raw binary")


def _code_type(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _signed(unique: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """The rows with `keys`, one for each table, and `codes`, their sign patterns in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes: list[bytes] = []
            keys: list[np.ndarray] = []
            for i in range(batch.num_rows):
                v = _matrix(batch.column("raw").slice(i, 1), kind)[0]
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([SEED, len(v)]).standard_normal((tables * bits, len(v)))
                mine = ((planes[len(v)] @ v > 0).reshape(tables, bits) * weights).sum(1)
                codes.append(mine.astype(_code_type(bits)).tobytes())
                keys.append((np.int64(len(v)) << 40) + (np.arange(tables, dtype=np.int64) << 24) + mine)
            offsets = pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32())
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            columns = [*(batch.column(c) for c in ("node", "copies", "raw")), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "copies", "raw", "codes", "keys"])

    return unique.select("node", "copies", "raw").mapInArrow(run, "node long, copies long, raw binary, codes binary, keys array<long>")


def _compare(cosine: float, bits: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, TILE_KEYS):
            ids, copies, side = (group.column(c).to_numpy() for c in ("node", "copies", "side"))
            v = _matrix(group.column("raw"), kind)
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), _code_type(bits)).reshape(len(ids), -1)
            earlier = codes[:, : (group.column("key")[0].as_py() >> 24) & 0xFFFF]
            across = group.column("lo")[0] != group.column("hi")[0]
            order = np.argsort(side, kind="stable")
            ids, copies, v, earlier = ids[order], copies[order], v[order], earlier[order]
            left = int((side == 0).sum()) if across else 0
            length = np.sqrt((v * v).sum(1))
            joined, count = Spanning(len(ids)), np.zeros(len(ids), np.int64)
            for start in range(left, len(ids), 256):
                stop = min(start + 256, len(ids))
                upto = left if across else stop
                found = (v[start:stop] @ v[:upto].T) / (length[start:stop, None] * length[None, :upto]) >= cosine
                if not across:
                    found &= np.arange(upto)[None, :] < np.arange(start, stop)[:, None]
                for r in np.flatnonzero(found.any(1)).tolist():
                    i, others = start + r, np.flatnonzero(found[r])
                    joined.add(i, others)
                    new = others[~(earlier[others] == earlier[i]).any(1)]
                    count[i] += copies[new].sum()
                    count[new] += copies[i]
            some = np.flatnonzero(count)
            pairs = np.array(joined.kept, int).reshape(-1, 2)
            a = np.concatenate([ids[some], ids[pairs[:, 0]]])
            b = pa.array(np.concatenate([ids[some], ids[pairs[:, 1]]]))
            n = np.concatenate([count[some], np.zeros(len(pairs), np.int64)])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """One row per vector: `id`, `n_links` (other vectors linked directly) and `component` (the smallest id reachable)."""
    stored = vectors.schema[vector_col].dataType
    kind = "<f4" if isinstance(stored, ArrayType) and isinstance(stored.elementType, FloatType) else "<f8"
    rows = stage(_digests(vectors, id_col, vector_col, kind), "vectors")
    alike = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    unique = stage(alike.withColumn("node", F.monotonically_increasing_id()), "unique")
    bits, tables = plan_tables(unique.count(), cosine, miss)
    keyed = stage(_signed(unique, bits, tables, kind), "signed")
    keys = keyed.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > tile)
    large = stage(keys.select("key", F.ceil(F.col("count") / tile).cast("int").alias("parts")), "large-keys")
    work = deal(keyed.select("node", "copies", "raw", "codes", F.explode("keys").alias("key")), large, F.col("node"))
    found = stage(work.mapInArrow(_compare(cosine, bits, kind), "a long, b long, n long"), "found")
    linked = connected_components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    joined = unique.select("digest", "node", "first_id", "copies").join(counts, F.col("node") == F.col("a"), "left").drop("a")
    linked = linked.withColumnRenamed("node", "linked_node")
    rooted = stage(
        joined.join(linked, F.col("node") == F.col("linked_node"), "left").select("digest", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")),
        "rooted",
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    per_vector = stage(rooted.join(names, "root").select("digest", "n_links", "component"), "per-vector")
    valid = rows.where("digest IS NOT NULL").select("id", "digest").join(per_vector, "digest").select("id", "n_links", "component")
    return valid.unionAll(rows.where("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
