"""A training-data pipeline: documents are scored, deduplicated, cut, mixed and encoded, a stage at a time.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns the documents that go on; every result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import bpe, mixing, near_copies, quality_classifier, substring
from threadlens.llm.common import stage, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return near_copies.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document are cut; documents of which nothing is left go."""
    cut = substring.dedup_substrings(docs)
    changed = F.size("removed_spans") > 0
    kept = cut.where(~changed | (F.trim("text") != ""))
    chars = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights; a document taken more than once is there more than once."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether decoding them gives the text."""
    rows = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    coded = bpe.encode_documents(rows, public_tokenizers.path("byte_bpe_50k.json"), id_col="row", decode=False, verify=True)
    return coded.select(
        F.col("id.doc_id").alias("doc_id"), F.col("id.source").alias("source"), F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.col("exact").alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Fitted models and content-defined chunks are beyond SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
