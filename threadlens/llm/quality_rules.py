"""Quality rules: Viterbi labels of lines, and plain counts that rule a document out beforehand.

The most probable sequence of labels under a linear-chain conditional random field (crf.py) marks each line as content or
boilerplate. A document is retained if enough of its text, by length, is content.

Defined results: a null or empty text has no words, so its counts are 0 and base_failed is true; whole texts are counted whatever
their length; repeated rows get the same verdict; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf

#: A document needs this many words, and at most this percentage of them in repeated three-word windows.
LEAST_WORDS = 50
MOST_REPEATED = 50

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more, first ones included; a word counts once."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()  # bytes split at exactly the six ASCII white-space characters
    joined = b"".join(words)
    continuing = int(((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80).sum())
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(words), len(joined) - continuing, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def judge(docs: DataFrame, model: crf.LineModel, *, id_col: str = "doc_id", text_col: str = "text", least_content: float = 0.5) -> DataFrame:
    """One row per document: id, the base counts, base_failed, content_share (of its text, by length) and kept."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in crf.slices(batch.column("text")):
                counts = np.array([base_counts(t) for t in texts], np.int64)
                failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
                lines = model.read(texts)
                share = model.share(model.viterbi(lines).astype(float), lines)
                columns = [batch.column("id").slice(at, len(texts)), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(share), pa.array(~failed & (share >= least_content))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
