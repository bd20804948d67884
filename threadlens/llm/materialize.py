"""Training-order materialisation: token sequences in fixed-stride binary shards, in a keyed random order.

Documents are cut into sequences of at most `length` tokens, the last one of a document ending with the end token. A document of b
bytes has b tokens at most, so it is given b // length + 1 places, in the order of the table's rows, of which its sequences take the
first ones. A keyed Feistel network permutes the numbers below the next power of four, and walking its cycle until it lands below the
number of places makes that a permutation of exactly these: place i goes to perm(i). What is taken, in that order, is the training order:
slots count the sequences without the places that are left free. Shards are ranges of `shard_slots` permuted places, so they hold that many
sequences at most, one after the other, each with the same number of bytes. The manifest has the number of sequences of each shard, from which
a slot is found by arithmetic; training reads files from start to end, in random order, and resumes anywhere.

The places before a row's first one need no tokens: a first pass adds up lengths per input partition (one number and one digest each
come to the driver), a second one encodes, once, and sends each sequence straight to its shard, so the network moves the tokens once and
nothing keeps them in between. Both passes must see the same rows in the same partitions, as scans of a table do; stage() other frames first.

A shard is written under a temporary name and renamed, and a repeated attempt writes the same bytes, so lost executors cost only
their tasks. With resume=True, shards that are there, which are whole as they were renamed, are left as they are, unless a finished run noted
another number of sequences; the manifest holds a digest of all ids and texts in order, so that shards of other rows are refused.

A slot's bytes: document id (int64), number of the sequence in its document (int32), number of tokens (int32), then `length` tokens
(uint16 below 65,536 ids, else uint32), the unused ones being the end token. All are little-endian.

Defined results: a null text counts as empty and gives one sequence with just the end token; a null id is written as the least
int64; repeated rows are separate sequences; extra columns are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BYTE_LEVEL_PATTERN
from .common import open_folder, text_slices

#: Written for a null document id.
NO_ID = -(1 << 63)

#: Partitions of the exchange at most; beyond that many shards, a task writes several.
MAX_WRITERS = 20_000

ROUNDS = 6


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of the numbers in `index`, all below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.frombuffer(hashlib.sha512(key.encode()).digest(), "<u8")[:ROUNDS]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def _sequences(tokenizer: str, length: int, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each sequence: the place of its document, and its tokens."""
    encoding = _encoding(tokenizer)
    end = encoding.n_vocab
    for i, text in enumerate(texts):
        tokens = np.array(array("I", [*encoding.encode_ordinary(text.decode()), end]))
        for at in range(0, len(tokens), length):
            yield i, tokens[at : at + length]


def _places(rows: DataFrame, length: int) -> tuple[list[int], str]:
    """The number of places of each partition, and a digest of all ids and texts in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, xxhash.xxh3_128()
        for batch in batches:
            row = 0
            for texts in text_slices(batch.column("text")):
                ids = batch.column("id").slice(row, len(texts)).fill_null(NO_ID).to_numpy()
                row += len(texts)
                for i, t in zip(ids.tolist(), texts, strict=True):
                    seen.update(struct.pack("<qQ", i, len(t)))
                    seen.update(t)
                    n += len(t) // length + 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()), "seen": pa.array([seen.digest()])})

    counted = {r.part: r for r in rows.mapInArrow(run, "part int, n long, seen binary").collect()}
    numbers = [counted[i].n if i in counted else 0 for i in range(max(counted, default=-1) + 1)]
    return numbers, hashlib.sha256(b"".join(bytes(counted[i].seen) for i in sorted(counted) if counted[i].n)).hexdigest()


def write_shards(
    docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 512, shard_slots: int = 16384, key: str = "order", resume: bool = False
) -> dict:
    """Writes the shards and a manifest to `path`, a folder that all executors share; returns the manifest."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    per_part, digest = _places(rows, length)
    first = np.concatenate([[0], np.cumsum(per_part)]).astype(np.int64)
    n = int(first[-1])
    vocab = _encoding(tokenizer).n_vocab
    wide = "<u2" if vocab < 1 << 16 else "<u4"
    manifest = {"places": n, "length": length, "shard_slots": shard_slots, "key": key, "token": wide, "end": vocab, "stride": 16 + length * np.dtype(wide).itemsize, "shards": -(-n // shard_slots), "rows": digest}
    fs, root = open_folder(path)
    fs.create_dir(root, recursive=True)
    note = f"{root}/manifest.json"
    old: dict = {}
    if resume and fs.get_file_info(note).is_file:
        with fs.open_input_stream(note) as f:
            old = json.loads(f.read())
            if any(old.get(k) != v for k, v in manifest.items()):
                raise ValueError(f"{path} holds shards of other parameters or rows")

    def noted(**more: object) -> dict:
        with fs.open_output_stream(note) as f:
            f.write(json.dumps(manifest | more).encode())
        return manifest | more

    if not n:
        return noted(sequences=0, counts=[])
    if not old:
        noted()
    shards, stride = manifest["shards"], manifest["stride"]

    def shard_file(shard: int) -> str:
        return f"shard-{shard:08d}.bin"

    there = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file} if resume else {}
    sizes = [there.get(shard_file(s), 0) for s in range(shards)]
    # A finished run has noted what each shard holds; of one that was stopped, what bears a shard's name is whole.
    counts = [z // stride if z == k * stride else 0 for z, k in zip(sizes, old.get("counts") or [z // stride for z in sizes], strict=True)]
    done = np.array(counts) > 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = int(first[part]) if part < len(per_part) else n
        for batch in batches:
            row = 0
            for texts in text_slices(batch.column("text")):
                ids = batch.column("id").slice(row, len(texts)).fill_null(NO_ID).to_numpy()
                row += len(texts)
                found = list(_sequences(tokenizer, length, texts))
                if not found:
                    continue
                owner = np.array([i for i, _ in found])
                numbers = np.arange(len(found)) - np.searchsorted(owner, owner)
                places = np.array([len(t) // length + 1 for t in texts])
                before = at + np.cumsum(places) - places
                slots = permuted(before[owner] + numbers, n, key)
                at += int(places.sum())
                keep = ~done[slots // shard_slots]
                if not keep.any():
                    continue
                heads = np.zeros(len(found), [("id", "<i8"), ("part", "<i4"), ("n", "<i4")])
                heads["id"], heads["part"], heads["n"] = ids[owner], numbers, [len(t) for _, t in found]
                record = [heads[i].tobytes() + found[i][1].astype(wide).tobytes() for i in np.flatnonzero(keep)]
                yield pa.RecordBatch.from_arrays([pa.array(slots[keep]), pa.array(record, pa.binary())], ["place", "record"])
        if part < len(per_part) and at != first[part + 1]:
            raise RuntimeError("the rows of a partition changed between the two passes; stage() the table first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(path)
        padding = np.full(length, vocab, wide).tobytes()
        out, name, shard, last, held = None, "", -1, -1, 0

        def closed() -> pa.RecordBatch:
            out.close()
            fs.move(name, f"{root}/{shard_file(shard)}")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([held], pa.int64())], ["shard", "n"])

        for batch in batches:
            for place, record in zip(batch.column("place").to_pylist(), batch.column("record"), strict=True):
                if place <= last:
                    raise RuntimeError(f"place {place} comes after {last}")
                last = place
                if place // shard_slots != shard:
                    if out is not None:
                        yield closed()
                    shard, held = place // shard_slots, 0
                    name = f"{root}/.{shard_file(shard)}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                raw = record.as_py()
                out.write(raw + padding[len(raw) - 16 :])
                held += 1
        if out is not None:
            yield closed()

    writers = min(shards, MAX_WRITERS)
    target = F.floor(F.col("place") / shard_slots) if shards == writers else F.floor(F.floor(F.col("place") / shard_slots) * writers / shards)
    sent = rows.mapInArrow(send, "place long, record binary").repartitionById(writers, target.cast("int")).sortWithinPartitions("place")
    for r in sent.mapInArrow(write, "shard long, n long").collect():
        counts[r.shard] = r.n
    return noted(sequences=sum(counts), counts=counts)


def read_shards(spark: SparkSession, path: str, slots: tuple[int, int] | None = None) -> DataFrame:
    """The sequences in training order within each shard: slot, shard, doc_id, part, n_tokens and tokens; `slots` is a half-open range."""
    fs, root = open_folder(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    low, high = slots or (0, m["sequences"])
    low, high = max(0, low), min(high, m["sequences"])
    ends = np.cumsum(m["counts"], dtype=np.int64)
    kind = np.dtype([("id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("tokens", m["token"], (m["length"],))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(path)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                start = int(ends[shard]) - m["counts"][shard]
                at, end = max(start, low), min(int(ends[shard]), high)
                if at >= end:
                    continue
                with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                    while at < end:
                        k = min(2048, end - at)
                        f.seek((at - start) * m["stride"])
                        got = np.frombuffer(f.read(k * m["stride"]), kind)
                        used = np.arange(m["length"]) < got["n"][:, None]
                        values = pa.array(got["tokens"][used].astype(np.int32))
                        offsets = pa.array(np.concatenate([[0], np.cumsum(got["n"])]).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(at, at + k)), pa.array(np.full(k, shard)), pa.array(got["id"], mask=got["id"] == NO_ID), pa.array(got["part"]), pa.array(got["n"]), pa.ListArray.from_arrays(offsets, values)],
                            ["slot", "shard", "doc_id", "part", "n_tokens", "tokens"],
                        )
                        at += k

    shards = range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high - 1, "right")) + 1) if high > low else range(0)
    todo = spark.range(shards.start, shards.stop, 1, max(1, min(len(shards), MAX_WRITERS)))
    return todo.mapInArrow(run, "slot long, shard long, doc_id long, part int, n_tokens int, tokens array<int>")
