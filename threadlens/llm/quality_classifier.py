"""Quality classifier: a conditional random field over the lines of a text.

Forward and backward passes give each line the probability of being good; their mean, weighted by the lines' lengths, is the
document's share of good text, and a logistic curve fitted on the same sample turns the share into a score.

Defined results: a null or empty text is one empty line and gets that line's score; texts of any length are scored as a whole;
equal texts get equal scores; extra columns are ignored by score() and kept by keep_good(); an empty table gives an empty result;
without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = crf.SAMPLE_DOCUMENTS) -> crf.LineModel:
    """A model fitted on at most `limit` labelled documents, none of them held out."""
    return crf.fit(*crf.sample(docs, labels.where(~held_out(labels[id_col])), id_col=id_col, text_col=text_col, label_col=label_col, limit=limit))


def score(docs: DataFrame, model: crf.LineModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `id` and `score`, from 0 to 1."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(batch.column("text"), model))], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")


def _scores(texts: pa.Array, model: crf.LineModel) -> np.ndarray:
    parts = [model.scores(model.read(part)) for part in crf.slices(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def keep_good(docs: DataFrame, model: crf.LineModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is at least `threshold`, with all their columns."""

    @F.arrow_udf("double")
    def text_score(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(texts, model))

    return docs.where(text_score(F.coalesce(docs[text_col], F.lit(""))) >= threshold)
