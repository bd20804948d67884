"""Document fingerprints: threshold-scaled sketches of word shingles, for likeness of documents of very unequal length.

A sketch holds every shingle hash below a fixed fraction of all hashes (1 / SCALE). Which hashes a sketch keeps depends on nothing but the hash,
so the sketch of two texts together is the union of theirs, and the share of a short text's hashes that a long one holds, too, estimates
how much of the short one it contains, whatever the lengths. Texts with few hashes below the threshold keep their LEAST smallest: then
the threshold is the largest hash kept, or there is none if the sketch holds all hashes. Two sketches are compared below the lower of
their thresholds. Likeness is the share of shared hashes in the sketch that is the smaller one there.

Shingles are five words (runs of characters other than space and U+0009 to U+000D), lower-cased; a text with fewer words is one shingle.
All of this is one expression over a row: a scan without shuffles.

Defined results: a null text counts as empty; a text without words has an empty sketch, which is like an empty one (1) and unlike all others
(0); texts of any length are sketched as a whole; repeated shingles count once; equal texts have equal sketches; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage

#: One hash in so many is below the threshold.
SCALE = 16

#: Hashes that a sketch has at least, if its text has as many shingles.
LEAST = 64

SHINGLE = 5

#: Rows between two cuts of the order of documents, about; a document repeated in more rows than this is dealt to several parts.
PART_ROWS = 20_000

#: Cuts at most; and parts for each partition of a shuffle at least, so that hashing them to partitions evens out.
PARTS = 1 << 16
PARTS_EACH = 4

#: Rows of a part's first document that are sent to the part before, about, if it has more.
GUESTS = 64

#: Hashes are signed, the least one is -2 ** 63.
THRESHOLD = -(1 << 63) + (1 << 64) // SCALE


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column) -> Column:
    """The sketch of a text: its kept hashes in ascending order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(each)

    return _kept(_let(words, hashes))


def _kept(hashes: Column) -> Column:
    # The few hashes below the threshold are found first; only where they don't suffice are all sorted.
    def choose(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < THRESHOLD)))
        return _let(low, lambda some: F.when(F.size(some) >= LEAST, some).otherwise(F.slice(F.array_sort(F.array_distinct(h)), 1, LEAST)))

    return _let(hashes, choose)


def union(a: Column, b: Column) -> Column:
    """The sketch of two texts together, from their sketches."""
    return _kept(F.concat(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller one's shingles that the other has, too: 0 to 1."""

    def limit(s: Column) -> Column:
        return F.when(F.size(s) < LEAST, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(THRESHOLD), F.get(s, F.size(s) - 1)))

    def share(x: Column) -> Column:
        smaller = F.least(F.size(x["a"]), F.size(x["b"]))
        return F.when(smaller > 0, F.size(F.array_intersect(x["a"], x["b"])) / smaller).otherwise(F.when(F.size(x["a"]) == F.size(x["b"]), 1.0).otherwise(0.0))

    def compared(t: Column) -> Column:
        return _let(F.struct(F.filter(a, lambda x: x <= t).alias("a"), F.filter(b, lambda x: x <= t).alias("b")), share)

    return _let(F.least(limit(a), limit(b)), compared)


def digits(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with their sketch in a column `sketch` (with underscores before it until docs has no such column)."""
    return docs.withColumn(fresh(docs, "sketch"), sketch(docs[text_col]))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """The documents and, as a struct `next`, these columns of the next one by id; the first one comes after the last.

    Null ids come first; documents of one id are in the order of a hash of their texts. Rows equal in both are one document: their next is the
    next different one (the same one if there is no other). Texts are shuffled once, to parts of the order; the cuts between parts come
    from a table of ids and hashes. The first document of a part is sent to the part before it, too. A part that is one document, many
    times repeated, is dealt out further.
    """
    key, part, place, drawn, guest = (fresh(docs, c) for c in ("key", "part", "place", "drawn", "guest"))
    came, came_guest, *came_rows = (fresh(docs, f"came_{c}") for c in ("key", "guest", *columns))
    hexed = lambda n: F.lpad(F.hex(n), 16, "0")
    order = F.concat(
        F.coalesce(hexed(docs[id_col].cast("long").bitwiseXOR(F.lit(-(1 << 63)))), F.lit("")), F.lit("."),
        hexed(F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).bitwiseXOR(F.lit(-(1 << 63)))),
    )
    counted = stage(docs.select(order.alias("key")).groupBy("key").count(), "keys")
    total = counted.agg(F.sum("count")).first()[0] or 0
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(PARTS, max(-(-total // part_rows), PARTS_EACH * shuffled)))
    heavy = -(-total // parts)
    ranged = counted.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).select("key")
    hot = [r.key for r in counted.where(F.col("count") > heavy).select("key").collect()]  # at most as many as there are parts
    cuts = sorted({*(r.key for r in ranged.collect()), *hot, *(h + "0" for h in hot)})
    if not cuts:
        return docs.withColumn("next", F.struct(*columns))

    def part_of(k: Column, edges: list[str]) -> Column:
        """The last edge that is not above the key, by halving."""
        known = F.split(F.lit(",".join(edges)), ",")
        steps = F.array(*[F.lit(1 << s) for s in range(len(edges).bit_length() - 1, -1, -1)])
        further = lambda at, step: (at + step < len(edges)) & (F.get(known, at + step) <= k)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))

    held = counted.select("key", "count", part_of(F.col("key"), cuts).alias("p")).groupBy("p").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.sum("count").alias("n"), F.min_by("count", "key").alias("n_first")).orderBy("key").collect()
    firsts = [r.key for r in held]
    # Parts of one repeated document are dealt out, the others stay whole.
    deals = [max(1, -(-r.n // heavy)) if r.key == r.last else 1 for r in held]
    # Of a first document with many rows, about one row in so many is sent: some GUESTS of them, so that one surely is.
    sends = [max(1, r.n_first // GUESTS) for r in held]
    first_of, deal_of, send_of = (F.split(F.lit(",".join(map(str, x))), ",") for x in (firsts, deals, sends))
    dealt = lambda p: F.get(deal_of, p).cast("long")
    rows = docs.withColumn(key, order)
    rows = rows.withColumn(part, part_of(F.col(key), firsts))
    ahead = F.pmod(F.col(part) - 1, F.lit(len(firsts)))
    own = F.array(F.struct(F.col(part).alias(part), F.col(place).alias(place), F.lit(False).alias(guest)))
    sent = F.transform(F.sequence(F.lit(0).cast("long"), dealt(ahead) - 1), lambda s: F.struct(ahead.alias(part), s.alias(place), F.lit(True).alias(guest)))
    is_sent = (F.get(first_of, F.col(part)) == F.col(key)) & (F.pmod(F.col(drawn), F.get(send_of, F.col(part)).cast("long")) == 0)
    rows = rows.withColumn(drawn, F.xxhash64(F.monotonically_increasing_id())).withColumn(place, F.pmod(F.col(drawn), dealt(F.col(part))))
    rows = rows.select(*docs.columns, key, F.inline(F.when(is_sent, F.concat(own, sent)).otherwise(own)))
    # From the last document back: the next one of a row is the last different one seen, guests being seen first. One exchange and one sort.
    back = Window.partitionBy(part, place).orderBy(F.desc(guest), F.desc(key))
    seen = {came: key, came_guest: guest, **dict(zip(came_rows, columns, strict=True))}
    rows = rows.withColumns({name: F.lag(c).over(back) for name, c in seen.items()})
    # The same key again is the same document, but a guest before it is the first one after the last, whatever its key.
    changed = F.when((F.col(came) != F.col(key)) | F.col(came_guest), F.struct(*[F.col(name).alias(c) for name, c in zip(came_rows, columns, strict=True)]))
    rows = rows.withColumn(came, F.last(changed, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where(~F.col(guest)).select(*docs.columns, F.col(came).alias("next"))


def edited(text: Column, other: Column) -> Column:
    """The text with the last half of its code points (rounded down) replaced by as many, or all, from the start of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))
