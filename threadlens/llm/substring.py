"""Substring dedup by content-defined chunking.

A gear rolling hash of the last 16 bytes decides before which words a text is cut, on average one in four, so the cuts inside a
passage are the same wherever it stands, and insertions elsewhere do not move them. A chunk's digest takes in the CONTEXT - 1 chunks
before it, so that short common chunks are no repetition by themselves. A chunk whose digest occurs earlier - in a document with a
smaller key, or earlier in the same one - is repeated, with the chunks of its context. Runs of repeated chunks of at least LEAST_WORDS
words are removed; the first occurrence stays.

A document's key is its id, then a hash of its text, then, for rows without an id, a row number that a staged table of these rows holds.
Occurrences, the gathering of places and the join of places and texts all go by the whole key.

How it scales: each task works on blocks of texts. In a block, only the first occurrence of a digest goes on; later ones are settled
there, so a passage that a third of all documents share reaches a reducer once per block. Digests go to reducers by hash, packed as
compressed arrays; reducers report which of these first occurrences come later than another block's. The places found are packed by
document, and texts are joined to them once, by key, and cut.

Defined results: a null text stays null and an empty one empty; texts of any length are chunked as a whole; rows with the same id and
the same text (repeated rows) are one document, so repeated rows keep their texts; rows that share an id and differ in text are
documents of their own, in the order of the texts' hashes; so is every row without an id, before all others; words are split at white
space only, so text without any is one chunk; extra columns are kept, but one named removed_spans is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, text_slices

#: One in so many words starts a chunk (a power of two), and the chunks that a digest covers.
CHUNK_WORDS = 4
CONTEXT = 3

#: Runs of repeated chunks are removed from this many words on.
LEAST_WORDS = 20

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20

NO_ID = -(1 << 63)

_GEAR = np.random.default_rng(1234).integers(0, 1 << 32, 256, np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PAD = 16


def chunk_starts(texts: list[bytes]) -> list[np.ndarray]:
    """Where the chunks of each text start: at 0, and at the words before which the gear hash says so."""
    raw = np.frombuffer((b"\n" * _PAD).join([b"", *texts, b""]), np.uint8)
    gear = _GEAR[raw]
    for step in (1, 2, 4, 8):  # sums of 2, 4, 8 and 16 shifted terms
        gear[step:] = gear[step:] + (gear[:-step] << np.uint32(step))
    space = _SPACE[raw]
    cut = np.flatnonzero(space[:-1] & ~space[1:] & ((gear[:-1] >> np.uint32(28)) & np.uint32(CHUNK_WORDS - 1) == 0)) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + _PAD) - sizes
    low, high = np.searchsorted(cut, begin, "right"), np.searchsorted(cut, begin + sizes, "left")
    return [np.concatenate([[0], cut[a:b] - s]) for a, b, s in zip(low.tolist(), high.tolist(), begin.tolist(), strict=True)]


def digests(text: bytes, starts: np.ndarray) -> np.ndarray:
    """For each chunk from number CONTEXT - 1 on, the digest of it and its context."""
    if len(starts) < CONTEXT:
        return np.zeros(0, np.uint64)
    ends = [*starts[1:].tolist(), len(text)]
    one = np.array([xxhash.xxh3_64_intdigest(text[a:b].rstrip()) for a, b in zip(starts.tolist(), ends, strict=True)], np.uint64)
    out = one[: len(one) - CONTEXT + 1].copy()
    for k in range(1, CONTEXT):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[k : len(one) - CONTEXT + 1 + k]
    return out ^ (out >> np.uint64(32))


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _take(columns: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    return [c[rows] for c in columns]


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before it; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _later(digest: np.ndarray, spot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first spot (key and place) of each digest, and one row of each spot after it."""
    order = np.argsort(digest, kind="stable")
    new = _changes([digest[order]])
    lone = new & np.append(new[1:], True)
    many = order[~lone]
    many = many[np.lexsort((*(c[many] for c in reversed(spot)), digest[many]))]
    first = _changes([digest[many]])
    after = _changes([digest[many], *_take(spot, many)]) & ~first
    return np.concatenate([order[lone], many[first]]), many[after]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(bucket[rows[0]]), rows


def _key_bucket(key: list[np.ndarray], buckets: int) -> np.ndarray:
    mixed = np.zeros(len(key[0]), np.uint64)
    for part in key:
        mixed = (mixed ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


_KEY = ["id", "hash", "row"]
_SPOT = (np.int64, np.int64, np.int64, np.int32)
_PACKED = "kind int, bucket long, payload binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "bucket", "payload"])


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The documents with the columns of their keys, and the names of these."""
    id_key, hash_key, row_key = keys = [fresh(docs, c) for c in ("key_id", "key_hash", "key_row")]
    number = F.col(id_col).cast("long")
    rows = docs.withColumns({id_key: F.coalesce(number, F.lit(NO_ID)), hash_key: F.xxhash64(F.col(text_col).cast("string"))})
    # The numbers must be the same whenever the table is read.
    unnamed = stage(rows.where(number.isNull()).withColumn(row_key, F.monotonically_increasing_id() + 1), "without-id")
    # Keys that cannot be null give both halves of the later join the same exchange.
    unnamed = unnamed.withColumns({k: F.coalesce(F.col(k), F.lit(NO_ID)) for k in keys})
    return rows.where(number.isNotNull()).withColumn(row_key, F.lit(0).cast("long")).unionAll(unnamed), keys


def repeated_chunks(docs: DataFrame, keys: list[str], *, text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per document with any: its key (`id`, `hash` and `row`) and `chunks`, the numbers of its chunks whose digest occurs earlier, as packed int32."""
    rows = docs.select(*[F.col(k).alias(c) for k, c in zip(keys, _KEY, strict=True)], F.col(text_col).alias("text")).where("text IS NOT NULL")
    n = buckets or max(256, 8 * docs.rdd.getNumPartitions())

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text"), BLOCK_BYTES):
                key = [batch.column(c).slice(at, len(texts)).to_numpy() for c in _KEY]
                at += len(texts)
                found = [digests(t, s) for t, s in zip(texts, chunk_starts(texts), strict=True)]
                sizes = np.array([len(f) for f in found])
                digest, key = np.concatenate(found), [np.repeat(k, sizes) for k in key]
                place = (np.arange(len(digest)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32) + np.int32(CONTEXT - 1)
                spot = [*key, place]
                first, after = _later(digest, spot)
                out = []
                for bucket, r in _by_bucket((digest[first] % np.uint64(n)).astype(np.int64)):
                    r = np.sort(first[r])
                    out.append((0, bucket, _pack(digest[r], *_take(spot, r))))
                for bucket, r in _by_bucket(_key_bucket(_take(key, after), n)):
                    r = np.sort(after[r])
                    out.append((1, bucket, _pack(*_take(spot, r))))
                yield _packed(out)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, payloads in _runs(batches, passing=True):
            if bucket is None:
                yield _packed(payloads)
                continue
            digest, *spot = (np.concatenate(c) for c in zip(*(_unpack(p, np.uint64, *_SPOT) for p in payloads), strict=True))
            _, after = _later(digest, spot)
            spot = _take(spot, after)
            found = [(1, bucket, _pack(*_take(spot, r))) for bucket, r in _by_bucket(_key_bucket(spot[:-1], n))]
            if found:
                yield _packed(found)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in _runs(batches):
            spot = [np.concatenate(c) for c in zip(*(_unpack(p, *_SPOT) for p in payloads), strict=True)]
            *key, place = _take(spot, np.lexsort(spot[::-1]))
            starts = np.flatnonzero(_changes(key))
            chunks = [np.unique(p).tobytes() for p in np.split(place, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in key), pa.array(chunks, pa.binary())], [*_KEY, "chunks"])

    blocks = rows.mapInArrow(chunked, _PACKED).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    places = blocks.mapInArrow(compared, _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return places.mapInArrow(gathered, "id long, hash long, row long, chunks binary")


def _runs(batches: Iterator[pa.RecordBatch], passing: bool = False) -> Iterator[tuple[int | None, list]]:
    """Payloads of consecutive rows of a bucket. With `passing`, rows of kind 1 come as they are, without a bucket, batch by batch."""
    held: list[bytes] = []
    now = -1
    for batch in batches:
        passed = []
        for kind, bucket, payload in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True):
            if passing and kind:
                passed.append((1, bucket, payload))
                continue
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(payload)
        if passed:
            yield None, passed
    if held:
        yield now, held


def repeated_spans(text: bytes, chunks: np.ndarray, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Byte spans of the runs of repeated chunks with at least least_words words."""
    starts = chunk_starts([text])[0]
    marked = np.zeros(len(starts), bool)
    for k in range(CONTEXT):
        marked[chunks - k] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    ends = np.append(starts, len(text))
    spans = [(int(ends[a]), int(ends[b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return [(a, b) for a, b in spans if len(text[a:b].split()) >= least_words]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with repeated runs cut from their texts; adds `removed_spans` (start and end, in code points of the old text)."""
    columns = [c for c in docs.columns if c != "removed_spans"]
    keyed, keys = with_keys(docs.select(*columns), id_col, text_col)
    chunks = stage(repeated_chunks(keyed, keys, text_col=text_col), "repeated-chunks")

    @F.arrow_udf("struct<text:string,spans:array<struct<start:bigint,end:bigint>>>")
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        kept, spans = [], []
        for text, mark in zip(texts, marks, strict=True):
            raw, numbers = (text.as_py() or "").encode(), np.frombuffer(mark.as_py() or b"", np.int32)
            found = repeated_spans(raw, numbers, least_words) if len(numbers) else []
            at, out, where = 0, [], []
            for a, b in found:
                out.append(raw[at:a])
                where.append({"start": len(raw[:a].decode()), "end": len(raw[:b].decode())})
                at = b
            kept.append(b"".join([*out, raw[at:]]).decode())
            spans.append(where)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(spans, kind)], ["text", "spans"])

    *marked, marked_chunks, result = (fresh(keyed, c) for c in ("marked_id", "marked_hash", "marked_row", "marked_chunks", "cut_result"))
    marks = chunks.select(*[F.col(c).alias(m) for c, m in zip(_KEY, marked, strict=True)], F.col("chunks").alias(marked_chunks)).hint("shuffle_hash")
    joined = keyed.join(marks, [F.col(k) == F.col(m) for k, m in zip(keys, marked, strict=True)], "left")
    # Texts without repeated chunks do not go through Python.
    whole = joined.where(F.col(marked_chunks).isNull()).select(*columns, F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed_spans"))
    changed = joined.where(F.col(marked_chunks).isNotNull()).withColumn(result, cut(F.col(text_col), F.col(marked_chunks)))
    changed = changed.select(*[F.col(result)["text"].alias(c) if c == text_col else F.col(c) for c in columns], F.col(result)["spans"].alias("removed_spans"))
    return whole.unionAll(changed)
