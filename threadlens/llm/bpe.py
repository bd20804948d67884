"""BPE encoding and decoding by a prefix-sharing trie.

A byte-pair encoding of a word has a useful property: the encoding of its first n bytes is the encoding of its first n - k bytes
followed by one last token of k bytes, and k is the only length whose token stays apart from the last token before it. So each node
of a trie of words needs just one number, the last token there, and a depth-first walk gives the encodings of all words, those of
shared prefixes once. Distinct words in sorted order are such a walk: the path that a word shares with the one before is kept.

Whether two tokens stay apart is found by undoing their merges, latest first, and looking for a merge across the border that would
have come earlier (`stays_apart`).

Words repeat far more often than texts do, so each Python worker keeps the encodings of up to MEMO_WORDS words across its tasks.

Defined results: a null text is encoded as the empty text, with no tokens; texts of any length are encoded as a whole; rows are
independent, so ties and repeated rows change nothing; extra columns are ignored; an empty table gives an empty result. Decoding
replaces bytes that are no valid UTF-8 by U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_slices

#: Words whose encodings a worker keeps, and pairs of tokens known to stay apart or not; about 200 bytes each.
MEMO_WORDS = 150_000
MEMO_PAIRS = 200_000

#: Texts are encoded in slices of about this many bytes; a slice's words are held as separate strings, some twenty times its size.
SLICE_BYTES = 1 << 20

#: Fixed value: how byte-level tokenizers cut a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable Latin-1 as it is, the others in order from U+0100 on."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The byte-level BPE of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        to_byte = byte_characters()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.vocab = vocab
        self.longest = max(map(len, vocab))
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = token
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        #: The merge that makes a token, as its rank and its two parts; single bytes have rank -1.
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        self.apart: dict[tuple[int, int], bool] = {}
        self.standing: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.words = regex.compile(BYTE_LEVEL_PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b in order of rank, leftmost first, ends with just these two tokens."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > MEMO_PAIRS:
                self.apart.clear()
            known = self.apart[a, b] = self._apart_below(a, b, len(self.merge))
        return known

    def _apart_below(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below limit crosses the border of a and b: their merges are undone, latest first."""
        rank = self.rank
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # a was made last; at its rank, the pair to the left went first
                limit, a = min(limit, rank[a]), self.right[a]
            else:  # b was made last; at its rank, the pair across the border would have gone first
                limit, b = min(limit, rank[b] + 1), self.left[b]

    def _stands(self, token: int) -> bool:
        """Whether merging a token's own bytes makes that token."""
        known = self.standing.get(token)
        if known is None:
            a, b, rank = self.left[token], self.right[token], self.rank[token]
            known = rank < 0 or self._apart_below(a, b, rank) and self._stands(a) and self._stands(b)
            self.standing[token] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words with their tokens, by a depth-first walk over the trie of the words."""
        vocab, longest, stays_apart = self.vocab, self.longest, self.stays_apart
        path, last = b"", [-1]  # the node's bytes, and the last token at each depth
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = vocab.get(word[start:end])
                    if token is not None and (stays_apart(last[start], token) if start else self._stands(token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            path = word
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end])
                end -= len(self.pieces[last[end]])
            yield word, tokens[::-1]

    def _pieces_of(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.words.findall(part)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The tokens of all texts in one array, and the number of tokens up to the end of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        pieces = [self._pieces_of(t.decode()) for t in texts]
        new = set().union(*pieces) - memo.keys()
        for s in new & self.special.keys():
            memo[s] = np.int32(self.special[s]).tobytes()
        for word, tokens in self.encode_words(w.encode() for w in new - self.special.keys()):
            memo[word.decode()] = np.array(tokens, np.int32).tobytes()
        raw = [b"".join(map(memo.__getitem__, p)) for p in pieces]
        ends = np.cumsum([len(r) // 4 for r in raw]).tolist()
        return np.frombuffer(b"".join(raw), np.int32), ends

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, verify: bool = False) -> DataFrame:
    """One row per document: `id`, `ids` (its tokens) and, on demand, `decoded` (the text that these tokens give) and `exact`.

    With `verify`, each document is decoded where it was encoded and `exact` tells whether that gave its text, so no text is sent back.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "ids", *(["decoded"] if decode else []), *(["exact"] if verify else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text"), SLICE_BYTES):
                ids, ends = bpe.encode(texts)
                starts = [0, *ends]
                columns = [batch.column("id").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))]
                if decode:
                    columns.append(pa.array([bpe.decode(ids[a:b]) for a, b in zip(starts, ends, strict=False)], pa.string()))
                if verify:
                    columns.append(pa.array([bpe.decode(ids[a:b]).encode() == t for a, b, t in zip(starts, ends, texts, strict=False)], pa.bool_()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {id_type}, ids array<int>" + (", decoded string" if decode else "") + (", exact boolean" if verify else ""))
