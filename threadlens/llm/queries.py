"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, embedding_dedup, materialize, mixing, quality_classifier, quality_rules, sharding, simhash, sketches, spelling, substring
from .common import stage_path, table

#: Production parameters of the sharding query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _ids_digest(ids: str) -> Column:
    """The SHA-256 of the decimal ids, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        quality_classifier.held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table is an event that opens a message; conversation -1 holds control strings as text."""
    control = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionAll(spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema))
    events = rows.select("conv_id", F.col("turn").alias("message_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    return chat.read_back(chat.render(chat.fold_events(events)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return cut.select("doc_id", F.size("removed_spans").alias("n_spans"), removed.alias("removed_chars"), spans.alias("spans"), "text")


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, SHARDS).select("doc_id", "slot", "shard")


def op7_write_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as it is read back from the shards."""
    path = stage_path(spark, "shards")
    materialize.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), path)
    read = materialize.read_shards(spark, path)
    return read.select("slot", "shard", "doc_id", "part", "n_tokens", _ids_digest("tokens").alias("tokens_sha256"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        _ids_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).withColumnRenamed("id", "doc_id")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of every document to a text that shares its first half, and to the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sketches.with_next(sketches.fingerprints(docs), ["text", "sketch"])
    rows = rows.withColumn("edited", sketches.edited(F.col("text"), F.col("next.text"))).withColumn("edited_sketch", sketches.sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.digits(F.col("sketch")).alias("fingerprint"),
        sketches.digits(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = alignment.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_scores": op3_quality_scores,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_shard_documents": op6_shard_documents,
    "op7_write_training_order": op7_write_training_order,
    "op8_bpe_encode_decode": op8_bpe_encode_decode,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_spelling_variants": op13_spelling_variants,
}

#: What is read back of a conversation, from its rows: the template puts 24 characters round a message and escapes control strings by one.
_CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

#: All pairs are compared, which the small tables allow.
_EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM good AS a JOIN good AS b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS node, r AS other FROM v UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
named AS (SELECT node, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = other GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN named ON node = r LEFT JOIN counted ON a = r
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op4_chat_formatting": _CHAT_SQL,
    "op9_embedding_near_dedup": _EMBEDDING_SQL,
    "op6_shard_documents": sharding.shard_sql(SHARDS),
    "op13_spelling_variants": spelling.VARIANTS_SQL,
}
