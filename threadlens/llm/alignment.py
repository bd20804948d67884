"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another, and how often corpus-wide.

Both tokenizers cut the same bytes. In a slice of texts laid end to end, running sums of token lengths are the ends of tokens; ends
common to both are the cuts between groups; a search in the cuts numbers each token's group. A token's links are the tokens of the other
side whose bytes overlap its own, a run of them found by two searches, and all runs are expanded at once by repetition.

A pair's count is the number of documents that hold it linked, over the whole corpus. Documents are encoded once; what is kept of each
is its distinct pairs with their numbers of links, in a table of the shared folder. Pairs are counted in two shuffles, salted and then
whole. Each document then needs the counts of its own pairs. The FREQUENT most frequent ones, a table of bounded size that holds nearly
all links, are handed to all tasks and looked up in place; only links of rarer pairs are shuffled, to the counts of their pairs, so no
frequent pair gathers rows in one task, and the counts of all pairs are exact.

The first tokenizer is a byte-level BPE, the second a sentencepiece model. The latter never has tokens across the start of a run of
spaces (checked when it is loaded), so a text is cut there and a worker keeps the encodings of up to MEMO_WORDS of these words.

Defined results: a null or empty text, and one whose tokens don't give its bytes back, has no tokens: zeros and an empty digest; texts
of any length are aligned as a whole; strings of special tokens are plain text; rows with a null id or with one id are separate
documents; repeated rows count again; ties for the highest count are all best; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BYTE_LEVEL_PATTERN, byte_characters
from .common import stage, text_slices

#: Words whose encodings a worker keeps; longer words than MEMO_CHARS are encoded anew.
MEMO_WORDS = 150_000
MEMO_CHARS = 64

#: Texts are aligned in slices of about this many bytes; the arrays of a slice take some sixty times as much.
SLICE_BYTES = 1 << 20

#: Pairs whose counts all tasks hold; 17 bytes each.
FREQUENT = 1 << 18

SALTS = 16

DOC = "row long, id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

#: U+2581 stands for a space in pieces.
SPACE = "▁"


def byte_level_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file, without special tokens; ids must be in the order of merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    special = {t["content"] for t in spec["added_tokens"]}
    to_byte = byte_characters()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    if any(a >= b for a, b in zip(merged[:-1], merged[1:], strict=True)):
        raise ValueError(f"{path}: ids are not in the order of merges")
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """A sentencepiece model; texts are encoded with the space that it puts before them."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in zip(ids, names, strict=True)]
        across = any(re.search(f"[^{SPACE}]{SPACE}", name) for name in names)
        self.words = re.compile(r" .*" if across else r" +[^ ]*", re.DOTALL)
        probe = self.model.encode("a")
        self.last_space = self.model.encode("a ")[len(probe) :]
        self.memo: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The tokens of texts that begin with a space, None where they don't give the text's bytes back."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, found = self.memo, [self.words.findall(t) for t in texts]
        new = list(set().union(*found) - memo.keys())
        for word, ids in zip(new, self.model.encode([w[1:] for w in new], num_threads=1), strict=True):
            ids = ids if word != " " else self.last_space
            same = b"".join(map(self.bytes.__getitem__, ids)) == word.encode()
            memo[word] = np.array(ids, np.int32).tobytes() if same else None
        out: list[np.ndarray | None] = []
        for words in found:
            parts = list(map(memo.__getitem__, words))
            out.append(None if None in parts else np.frombuffer(b"".join(parts), np.int32))
        for word in new:
            if len(word) > MEMO_CHARS:
                del memo[word]
        return out


class Pair:
    """Two tokenizers, the lengths of their tokens in bytes, and ids as text."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = byte_level_encoding(a), Pieces(b)
        self.size_a, self.size_b = self.a.n_vocab, len(self.b.bytes)
        self.len_a, self.len_b = np.zeros(self.size_a, np.int64), np.array(list(map(len, self.b.bytes)), np.int64)
        for token in self.a.token_byte_values():
            self.len_a[self.a.encode_single_token(token)] = len(token)
        self.named = [b"%d%c" % (i, mark) for i in range(max(self.size_a, self.size_b)) for mark in b",|;"]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The tokens of a space and the text by both; None for empty texts and where bytes don't come back."""
        spaced = [" " + t.decode() for t in texts]
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for raw, text, b in zip(texts, spaced, self.b.encode(spaced), strict=True):
            if not raw or b is None:
                out.append(None)
                continue
            a = self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            out.append((a, b.astype(np.int64)) if self.a.decode_bytes(a.tolist()) == b" " + raw else None)
        return out


@lru_cache(maxsize=2)
def load(a: str, b: str) -> Pair:
    return Pair(a, b)


def align(pair: Pair, texts: list[bytes]) -> list[tuple]:
    """Per text n_a, n_b, n_groups, n_links, the digest of its groups, its distinct pairs (a * size_b + b) and the links of each."""
    coded = pair.encode(texts)
    live = [i for i, c in enumerate(coded) if c is not None]
    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
    out: list[tuple] = [none] * len(texts)
    if not live:
        return out
    n_a, n_b = (np.array([len(coded[i][side]) for i in live]) for side in (0, 1))
    a, b = (np.concatenate([coded[i][side] for i in live]) for side in (0, 1))
    ends_a, ends_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    text_ends = np.cumsum([len(texts[i]) + 1 for i in live])  # each is a cut
    n_groups = np.diff(np.searchsorted(cuts, text_ends, "right"), prepend=0)
    # The run of b's tokens that overlap each token of a.
    first, last = np.searchsorted(ends_b, ends_a - pair.len_a[a], "right"), np.searchsorted(ends_b, ends_a)
    runs = last - first + 1
    before = np.cumsum(runs) - runs
    other = np.repeat(first - before, runs) + np.arange(int(runs.sum()))
    codes = pair.size_a * pair.size_b
    own = np.repeat(np.repeat(np.arange(len(live)), n_a) * codes + a * pair.size_b, runs)
    coded_pairs, times = np.unique(own + b[other], return_counts=True)
    bounds = np.searchsorted(coded_pairs, np.arange(len(live) + 1) * codes)
    n_links = np.add.reduceat(runs, np.cumsum(n_a) - n_a)
    # Groups as text: a's tokens of a group come after b's of the groups before, b's after a's of the same group.
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    names = np.empty(len(a) + len(b), np.int64)
    names[place_a] = 3 * a + np.append(group_a[1:] != group_a[:-1], True)
    names[place_b] = 3 * b + 2 * np.append(group_b[1:] != group_b[:-1], True)
    ends = np.cumsum(n_a + n_b)
    for k, i in enumerate(live):
        written = b"".join(map(pair.named.__getitem__, names[ends[k] - n_a[k] - n_b[k] : ends[k]].tolist()))[:-1]
        mine = slice(bounds[k], bounds[k + 1])
        out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(written).hexdigest(), coded_pairs[mine] - k * codes, times[mine].astype(np.int32))
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(list(map(len, parts)))), pa.int32()), pa.array(np.concatenate(parts), kind))


def aligned(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `row` (its number in this table), `id`, numbers, digest, and `pairs` with the links (`times`) of each."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(a, b)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                found = list(zip(*align(pair, texts), strict=True))
                numbers = [pa.array(c, pa.int64()) for c in found[:4]]
                here = [batch.column(c).slice(at, len(texts)) for c in ("row", "id")]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*here, *numbers, pa.array(found[4]), _lists(found[5], pa.int64()), _lists(found[6], pa.int32())], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return rows.mapInArrow(run, DOC.format(rows.schema["id"].dataType.simpleString()))


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """Of each pair `n`, the number of documents that hold it linked, and `best`, whether no pair of its first id has more."""
    each = found.select(F.explode("pairs").alias("pair"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    salted = each.groupBy("pair", "salt").agg(F.count("*").alias("n"))
    counted = stage(salted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / size_b)), "pair-counts")
    top = counted.groupBy("a").agg(F.max("n").alias("top"))
    return counted.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _links(found: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """Per document row `n_best` and `count_sum`, looked up in place for the frequent pairs and by a shuffle for the others."""
    spark = found.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().combine_chunks().sort_by("pair")
    shared = spark.sparkContext.broadcast([top.column(c).to_numpy() for c in ("pair", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            mine, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
            known = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            at = at[known]
            sums = [np.zeros(len(mine) + 1, np.int64), np.zeros(len(mine) + 1, np.int64)]
            sums[0][1:][known], sums[1][1:][known] = times[known] * best[at], times[known] * n[at]
            by_row = [np.diff(np.cumsum(s)[ends]) for s in sums]
            row = batch.column("row").to_numpy()
            rare = np.repeat(row, np.diff(ends))[~known]
            # A document's sums come with a number below zero in place of a pair.
            columns = [np.append(row, rare), np.append(-1 - row, mine[~known]), np.append(0 * row, times[~known]), np.append(by_row[0], 0 * rare), np.append(by_row[1], 0 * rare)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "pair", "times", "n_best", "count_sum"])

    parts = found.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long, n_best long, count_sum long")
    met = parts.join(counts, "pair", "left")
    return met.groupBy("row").agg(
        F.sum(F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )


def align_documents(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: `id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum` and `groups_sha256`.

    `a` is the file of a byte-level BPE, `b` that of a sentencepiece model; both are given a space and the text.
    """
    found = stage(aligned(docs, a, b, id_col=id_col, text_col=text_col), "aligned")
    counts = stage(pair_counts(found, load(a, b).size_b), "pairs")
    sums = _links(found, counts, frequent)
    return found.drop("pairs", "times").join(sums, "row").select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
