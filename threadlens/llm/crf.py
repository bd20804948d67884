"""A linear-chain conditional random field that labels the lines of a text good (1) or bad (0).

A line is described by shares of character classes and by repetition, and by the same of the lines before and after it. The field
has one weight for each of these and one for each pair of labels of consecutive lines. It is fitted on a bounded sample of labelled
documents, every line of which takes the label of its document; lines of a kind that both sorts of documents have end up undecided
and follow their neighbours.

All work is done in numpy over the lines of many texts at once. Texts are read in slices bounded by their lines as well as by their bytes;
of a text with more lines than that, the features are made and turned into log-odds piece by piece, and chains.py walks it in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chains
from .common import SLICE_BYTES, stage, text_slices

#: Labelled documents that a model is fitted on, at most; the most lines that one of these may have; the most lines of all together.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 2000
SAMPLE_TOTAL_LINES = 300_000

#: Lines whose features are held at a time, each about 1 kB.
SLICE_LINES = 1 << 16

#: Byte classes: 0 lower case and beyond ASCII, 1 upper case, 2 digits, 3 white space, 4 junk symbols, 5 ! and ?, 6 others.
_CLASSES = np.zeros(256, np.int64)
_CLASSES[:128] = 6
_CLASSES[[*range(97, 123)]] = 0
_CLASSES[[*range(65, 91)]] = 1
_CLASSES[[*range(48, 58)]] = 2
_CLASSES[[32, *range(9, 14)]] = 3
_CLASSES[[*b"#*$%&|<>{}[]=_~^\\@"]] = 4
_CLASSES[[*b"!?"]] = 5

OWN_FEATURES = 13
FEATURES = 3 * OWN_FEATURES + 1


@dataclass
class Lines:
    """The lines of some texts: features, length in bytes, and the number of lines of each text."""

    x: np.ndarray
    size: np.ndarray
    per_text: np.ndarray


@dataclass
class Read:
    """The lines of some texts as the chain sees them: log-odds of label 1, length in bytes, and the number of lines of each text."""

    odds: np.ndarray
    size: np.ndarray
    per_text: np.ndarray


def slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """Consecutive texts of about SLICE_BYTES and at most SLICE_LINES lines; one longer text stands alone."""
    for part in text_slices(texts, SLICE_BYTES):
        held: list[bytes] = []
        lines = 0
        for text in part:
            more = text.count(b"\n") + 1
            if held and lines + more > SLICE_LINES:
                yield held
                held, lines = [], 0
            held.append(text)
            lines += more
        yield held


def _own_features(texts: list[bytes], seen: set[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What lines are like by themselves, without first and last ones; `seen` holds earlier lines of the only text."""
    split = [t.split(b"\n") for t in texts]
    per_text = np.array([len(s) for s in split])
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    n = int(per_text.sum())
    own = np.zeros((n, OWN_FEATURES))
    kind = _CLASSES[raw]
    if len(raw) > 1:  # upper-case Latin-1 letters in UTF-8
        kind[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] = 1
    breaks = raw == 10
    line = np.cumsum(breaks) - breaks
    counts = np.bincount(line * 7 + kind, minlength=7 * n).reshape(n, 7).astype(float) if len(raw) else np.zeros((n, 7))
    size = np.array([len(s) for part in split for s in part])
    letters = np.maximum(1, size)
    for i, k in enumerate((1, 2, 4, 5, 6)):
        own[:, i] = counts[:, k] / letters
    at = 0
    for part in split:
        earlier: set[bytes] = set() if seen is None else seen
        for s in part:
            words = s.split()
            m = len(words)
            if m:
                row = own[at]
                row[5] = np.log1p(m)
                row[6] = len(s) / m
                row[7] = sum(map(eq, words, words[1:])) / m
                row[8] = 1 - len(set(words)) / m
                row[9] = s in earlier
                earlier.add(s)
            at += 1
    own[:, 10] = size == 0
    return own, size, per_text


def line_features(texts: list[bytes]) -> Lines:
    own, size, per_text = _own_features(texts)
    first = np.cumsum(per_text) - per_text
    own[first, 11] = 1
    own[first + per_text - 1, 12] = 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + per_text - 1] = 0
    return Lines(np.hstack([own, before, after, np.ones((len(own), 1))]), size, per_text)


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text without the line feeds between pieces of at most SLICE_LINES lines and, unless a line is longer, SLICE_BYTES; whether it is the last."""
    start = at = lines = 0
    while (end := text.find(b"\n", at)) >= 0:
        lines += 1
        if lines == SLICE_LINES or end - start >= SLICE_BYTES:
            yield text[start:end], False
            start, lines = end + 1, 0
        at = end + 1
    yield text[start:], True


def _features_in_pieces(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of line_features([text]) and the lengths of lines, piece by piece; a piece waits for the first line of the next."""
    seen: set[bytes] = set()
    held, held_size, last = None, None, np.zeros((1, OWN_FEATURES))

    def whole(own: np.ndarray, after: np.ndarray) -> np.ndarray:
        return np.hstack([own, np.vstack([last, own[:-1]]), np.vstack([own[1:], after]), np.ones((len(own), 1))])

    for piece, ends in _pieces(text):
        own, size, _ = _own_features([piece], seen)
        own[0, 11], own[-1, 12] = held is None, ends
        if held is not None:
            yield whole(held, own[:1]), held_size
            last = held[-1:]
        held, held_size = own, size
    yield whole(held, np.zeros((1, OWN_FEATURES))), held_size


class _Walk:
    """The steps along all chains: at step t, the rows of the texts with more than t lines."""

    def __init__(self, per_text: np.ndarray) -> None:
        order = np.argsort(-per_text, kind="stable")
        self.first = (np.cumsum(per_text) - per_text)[order]
        lengths = per_text[order]
        self.longest = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(self.longest), side="right")
        self.last = self.first + lengths - 1

    def rows(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


@dataclass
class LineModel:
    """Fitted weights: of features for label 1, and of label pairs; `scale` calibrates a document's share of good lines."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def _odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation @ self.weights, -30, 30)

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        good = self._odds(x)
        return np.stack([np.exp(-good / 2), np.exp(good / 2)], 1)

    def read(self, texts: list[bytes]) -> Read:
        """The lines of a slice of texts (see slices())."""
        if len(texts) > 1 or not texts or texts[0].count(b"\n") < SLICE_LINES and len(texts[0]) <= 2 * SLICE_BYTES:
            return self.of(line_features(texts))
        parts = [(self._odds(x), size) for x, size in _features_in_pieces(texts[0])]
        odds, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        return Read(odds, size, np.array([len(odds)]))

    def of(self, lines: Lines) -> Read:
        return Read(self._odds(lines.x), lines.size, lines.per_text)

    def marginals(self, lines: Read) -> np.ndarray:
        """The probability of label 1 for each line, by forward and backward passes."""
        return chains.marginals(lines.odds, self.pairs, lines.per_text)

    def viterbi(self, lines: Read) -> np.ndarray:
        """The most probable labels of each text's lines together."""
        return chains.viterbi(lines.odds, self.pairs, lines.per_text)

    def share(self, good: np.ndarray, lines: Read) -> np.ndarray:
        """Per text, the mean of `good` over its lines, weighted by their lengths."""
        weight = lines.size + 1.0
        first = np.cumsum(lines.per_text) - lines.per_text
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def scores(self, lines: Read) -> np.ndarray:
        share = np.clip(self.share(self.marginals(lines), lines), 1e-6, 1 - 1e-6)
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * np.log(share / (1 - share)) + b)))


def _forward_backward(psi: np.ndarray, pairs: np.ndarray, walk: _Walk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward values, and the expected number of each pair of labels."""
    alpha, beta, expected = psi.copy(), np.ones_like(psi), np.zeros((2, 2))
    for t in range(walk.longest):
        rows = walk.rows(t)
        now = alpha[rows] if t == 0 else (alpha[rows - 1] @ pairs) * psi[rows]
        alpha[rows] = now / now.sum(1, keepdims=True)
    for t in range(walk.longest - 1, 0, -1):
        rows = walk.rows(t)
        ahead = psi[rows] * beta[rows]
        joint = alpha[rows - 1][:, :, None] * pairs * ahead[:, None, :]
        total = joint.sum((1, 2), keepdims=True)
        expected += (joint / total).sum(0)
        now = ahead @ pairs.T
        beta[rows - 1] = now / now.sum(1, keepdims=True)
    return alpha, beta, expected


def fit(lines: Lines, labels: np.ndarray, steps: int = 250, penalty: float = 1e-3) -> LineModel:
    """Maximum likelihood by gradient steps with momentum (Adam). Without texts of both labels, a model that scores all 0.5."""
    x = lines.x
    mean, deviation = (x.mean(0), x.std(0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    mean[-1], deviation[-1] = 0, 1
    deviation[deviation < 1e-9] = 1
    model = LineModel(mean, deviation, np.zeros(FEATURES), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        return model
    y = np.repeat(labels, lines.per_text)
    scaled, walk = (x - mean) / deviation, _Walk(lines.per_text)
    same = np.zeros((2, 2))
    for label in (0, 1):
        same[label, label] = (lines.per_text[labels == label] - 1).sum()
    theta, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, steps + 1):
        model.weights, model.pairs = theta[:FEATURES], np.clip(theta[FEATURES:].reshape(2, 2), -4, 4)
        alpha, beta, expected = _forward_backward(model._emissions(x), np.exp(model.pairs), walk)
        both = alpha * beta
        slope = np.concatenate([scaled.T @ (y - both[:, 1] / both.sum(1)), (same - expected).ravel()]) / len(y) - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    model.weights, model.pairs = theta[:FEATURES], np.clip(theta[FEATURES:].reshape(2, 2), -4, 4)
    read = model.of(lines)
    share = np.clip(model.share(model.marginals(read), read), 1e-6, 1 - 1e-6)
    z, a, b = np.log(share / (1 - share)), 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression of the labels on the shares
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(hess, [((labels - p) * z).sum() - 1e-2 * (a - 1), (labels - p).sum() - 1e-2 * b])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    model.scale = (float(max(a, 0.05)), float(b))
    return model


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = SAMPLE_DOCUMENTS, total_lines: int = SAMPLE_TOTAL_LINES) -> tuple[Lines, np.ndarray]:
    """Line features and labels of at most `limit` labelled documents and `total_lines` lines, drawn evenly by a hash of the ids."""
    drawn = (
        labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("label"))
        .where("label IN (0, 1) AND label_id IS NOT NULL")
        .distinct()
        .orderBy(F.xxhash64("label_id"), "label_id", "label")
        .limit(limit)
    )
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("label_id")).select("label_id", "label", "text")
    # Texts of too many lines are left out before their features are made.
    whole = F.coalesce("text", F.lit(""))
    texts = texts.where(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) < SAMPLE_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                label_id, label = (batch.column(c).slice(at, len(part)) for c in ("label_id", "label"))
                at += len(part)
                lines = line_features(part)
                ends = np.cumsum(lines.per_text)
                x = [lines.x[b - k : b].astype(np.float32).tobytes() for b, k in zip(ends, lines.per_text, strict=True)]
                size = [lines.size[b - k : b].tobytes() for b, k in zip(ends, lines.per_text, strict=True)]
                yield pa.RecordBatch.from_arrays([label_id, label, pa.array(x, pa.binary()), pa.array(size, pa.binary())], ["label_id", "label", "x", "size"])

    id_type = texts.schema["label_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"label_id {id_type}, label int, x binary, size binary")
    # One text for each label drawn, however many rows have its id; of these, in the order drawn, as many as the driver has room for.
    ones = stage(found.groupBy("label_id", "label").agg(F.min(F.struct("label", "size", "x")).alias("one")), "sample")
    drawn_order = Window.orderBy(F.xxhash64("label_id"), "label_id", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = ones.select("label_id", "label", F.sum(F.length("one.size") / 8).over(drawn_order).alias("lines")).where(F.col("lines") <= total_lines)
    rows = [r.one for r in ones.join(room.select("label_id", "label"), ["label_id", "label"], "left_semi").select("one").collect()]
    rows.sort(key=lambda r: (r.label, r["size"], r.x))
    per_text = np.array([len(r["size"]) // 8 for r in rows], int)
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, FEATURES).astype(float)
    return Lines(x, np.frombuffer(b"".join(r["size"] for r in rows), np.int64), per_text), np.array([r.label for r in rows], int)
