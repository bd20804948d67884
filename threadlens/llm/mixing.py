"""Mixing sources to target weights, with DataFrame operations only.

Efraimidis-Spirakis sampling: each document draws u in (0, 1) from its id and text and gets the exponential key -ln(u) / w, w being its
quality weight; within a source, documents are taken in the order of their keys until the source's budget of words is used up.
A budget of several times the source takes complete epochs first; the rest is selected by key.

No source is ever sorted as a whole. A key falls into one of `buckets` ranges; sums per source and range tell in which range a
budget ends, so ranges below it are taken, ranges above it are not, and only the rows of that one range are sorted and
prefix-summed. A source with a third of all rows thus costs a sort of a thousandth of them.

The table of sources (one row each) is ranked in one task. Nothing else is gathered.

Defined results: a null text has no words; a null source is a source of its own, last in order; rows without words take nothing;
documents without an id draw by their texts; rows equal in id and text have equal keys, and which of them is taken makes no difference; extra columns are ignored by mix() and kept by mix_documents();
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: Characters that mark junk; their share lowers a document's quality weight.
JUNK = "#*$%&|<>!{}[]=_~^\\@"

#: The order within a source, with the size last.
ORDER = ("key", "id")

#: Quality weights lie between this and 1.
LEAST_WEIGHT = 0.25


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text free of junk characters, falling to LEAST_WEIGHT where a fifth of the characters are junk."""
    text = F.coalesce(text, F.lit(""))
    junk = F.length(text) - F.length(F.translate(text, JUNK, ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(4.0) * junk / F.greatest(F.length(text), F.lit(1)))


def sampling_key(doc_id: Column, size: Column, text_md5: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight; u comes from the first 52 bits of an MD5 of id, size and text, so that reruns and other engines agree."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), text_md5))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def key_bucket(key: Column, buckets: int) -> Column:
    """A rising function of the key under which no bucket gets more than about twice its share, for weights of 0.25 to 1."""
    spread = F.lit(1.0) - (F.exp(-key) + F.exp(-key * LEAST_WEIGHT)) / 2
    return F.least(F.floor(spread * buckets), F.lit(buckets - 1)).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[int], total_share: float, max_epochs: int) -> DataFrame:
    """Adds `target` to (source, source_size): words by weight, at most max_epochs times the source, the excess reshared.

    Resharing until none is above its limit ends where all sources below their limit have the same target per weight. Sources in
    the order of limit / weight reach their limits one after another, so that level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    every = Window.partitionBy()
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(cycle, (place + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
        (F.sum("source_size").over(every) * F.lit(float(total_share))).alias("total"),
    ).withColumn("reach", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.col("total") - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(every)
    # Once a source stays below its limit all later ones do, and their levels agree but for rounding: the first has the fewest terms.
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "source", "level"))).over(every)["level"]
    return levels.withColumn("shared", F.coalesce(first, level)).select(
        "source",
        "source_size",
        F.when(F.col("shared").isNull() | (F.col("reach") <= F.col("shared")), F.col("cap").cast("double"))
        .otherwise(F.col("shared") * F.col("weight"))
        .alias("target"),
    )


def _source_plan(keyed: DataFrame, weights: Sequence[int], total_share: float, max_epochs: int) -> DataFrame:
    """Per source: its size and target, complete epochs, words beyond them, and where in the key ranges these words end."""
    ranges = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, total_share, max_epochs).select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
    )
    targets = targets.withColumn("quota", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranges.withColumn("through", F.sum("range_size").over(upto))
    ends = sums.join(targets, sums["source"].eqNullSafe(targets["s"]))
    last = F.when(F.col("through") > F.col("quota"), F.struct("bucket", (F.col("through") - F.col("range_size")).alias("before")))
    return (
        ends.groupBy("s")
        .agg(*[F.first(c).alias(c) for c in ("source_size", "target", "epochs", "quota")], F.min(last).alias("end"))
        .select("s", "source_size", "target", "epochs", "quota", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before"))
    )


def _take(keyed: DataFrame, plan: DataFrame, row: str | None = None) -> DataFrame:
    """Adds source_size, target and taken to rows with source, size, key and bucket.

    With `row`, the name of a column of row numbers, the running sums are taken without the other columns and joined to them.
    """
    rows = keyed.join(plan, keyed["source"].eqNullSafe(plan["s"]))
    whole = F.col("epochs") * F.col("size")
    at_end = F.col("bucket").eqNullSafe(F.col("end_bucket"))
    clear = rows.where(~at_end).withColumn("taken", whole + F.when(F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")), F.col("size")).otherwise(F.lit(0)))
    so_far = Window.partitionBy("source").orderBy(*ORDER, "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("end_before") + F.coalesce(F.sum("size").over(so_far), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - before))
    if row is None:
        return clear.unionByName(rows.where(at_end).withColumn("taken", whole + part))
    ends = rows.where(at_end)
    split = ends.select(row, *ORDER, "source", "size", "epochs", "quota", "end_before").withColumn("taken", whole + part).select(F.col(row).alias("split_row"), "taken")
    return clear.unionByName(ends.join(split, F.col(row) == F.col("split_row")).drop("split_row"))


def _keyed(text: Column, doc_id: Column, source: Column, seed: str, buckets: int, *more: Column):
    size = n_words(text)
    return lambda docs: (
        docs.select(*more, doc_id.alias("id"), source.cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"), quality_weight(text).alias("weight"))
        .withColumn("key", sampling_key(F.col("id"), F.col("size"), F.col("text_md5"), F.col("weight"), seed)).drop("text_md5")
        .withColumn("bucket", key_bucket(F.col("key"), buckets))
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    total_share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    buckets: int = 1024,
) -> DataFrame:
    """One row per document: id, source, size, weight, key, source_size, target and `taken`, the words the mix takes of it.

    `weights` repeat over the sources in the order of their code points. All targets together are total_share of all words; none
    is above max_epochs times its source. The one document of a source in which the budget ends gives its leading words.
    """
    keyed = stage(_keyed(F.col(text_col), F.col(id_col), F.col(source_col), seed, buckets)(docs), "mix-keys")
    plan = stage(_source_plan(keyed, weights, total_share, max_epochs), "mix-plan")
    return _take(keyed, plan).select("id", "source", "size", "weight", "key", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    word = F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){")
    return F.call_function("regexp_extract", text, F.concat(word, n.cast("string"), F.lit("}+")), F.lit(0))


def mix_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str | None = "n_chars",
    weights: Sequence[int] = (5, 2, 1),
    total_share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    buckets: int = 1024,
) -> DataFrame:
    """The mixed documents with all their columns: a row for each time a document is taken, the last one cut where the budget ends."""
    columns = docs.columns
    keyed = _keyed(F.col(text_col), F.col(id_col), F.col(source_col), seed, buckets, F.struct(*[docs[c] for c in columns]).alias("doc"))(docs)
    # Texts are counted once and kept beside what was counted, so the plan and the running sums read narrow columns only.
    keyed = stage(keyed.withColumn("row", F.monotonically_increasing_id()), "mix-documents")
    plan = stage(_source_plan(keyed.select("source", "bucket", "size"), weights, total_share, max_epochs), "mix-plan")
    taken = _take(keyed, plan, "row").where("taken > 0").select("doc", "size", "taken")
    copies = taken.select("doc", "size", F.explode(F.sequence(F.col("taken"), F.lit(1).cast("long"), -F.col("size"))).alias("left"))
    text = F.col("doc")[text_col]
    cut = F.when(F.col("left") < F.col("size"), first_words(text, F.col("left"))).otherwise(text)
    out = copies.select(*[F.col("doc")[c].alias(c) for c in columns if c not in (text_col,)], cut.alias(text_col))
    if chars_col in columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*columns)


#: The same for DuckDB.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / greatest(0.25::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE
        * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!{}\\[\\]=_~^\\\\@]', '', 'g')))
        / greatest(length(coalesce(text, '')), 1)) AS key
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
    2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total
  FROM sources),
levels AS (
  SELECT *, cap::DOUBLE / weight AS reach,
    (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
shared AS (SELECT arg_min(level, reach) FILTER (level <= reach) AS shared FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN shared IS NULL OR reach <= shared THEN cap::DOUBLE ELSE shared * weight END AS target
  FROM levels, shared),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size
    - coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)))::BIGINT AS taken
FROM keyed JOIN planned ON keyed.source IS NOT DISTINCT FROM planned.source
"""
