"""Spelling variants: words within one edit of each other, and for each the much more frequent word that it may be a slip of.

One inserted, deleted or replaced character leaves a half of the shorter word intact: two words of which the shorter has m characters
share their first m // 2 or their last m - m // 2. So the dictionary is sorted twice, by leading halves and by trailing halves read
backwards, and is scanned in ranges: only words of a block, which share such a half, are compared. A word is in the blocks of its own
length and of the length below (as the longer word of a pair).

A block of more than BLOCK words is subdivided by the same argument on what its words do not share yet: a half of that is intact, too.
That goes on until blocks are small or a single character is left, where a block holds no more words than there are one and two
characters. Blocks are subdivided in Spark, level by level, and dealt anew, so no frequent half lands in one task.

A pair can share both halves ("aab", "aaab"). It belongs to one block only: the place of an edit is taken to be the first
place at which the words differ, a block stands for a range of places, from `p` to below `hi`, and pairs outside it are left to others.

Defined results: a null text has no words, a null id is written as an empty text in the checksums; repeated rows count again; runs of
any length are words; ties between equally frequent near words go to the smallest in code-point order; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Words of a block; larger ones are subdivided.
BLOCK = 256

#: Bytes of the characters of words that are compared at a time.
COMPARED_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PLACE = ["m", "p", "s", "hi"]
SORTED = [*PLACE, "head", "tail"]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, slip_every: int = 97) -> DataFrame:
    """`word` and `n`: the letter runs of all texts, A-Z lower-cased, one run in `slip_every` with a character left out.

    A run loses the character at place h % length if slip_every divides h, the CRC-32 of "<id>:<run>"; 0 leaves all runs as they are.
    """
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.split(docs[text_col], "[^A-Za-zÀ-ÿ]+")).alias("run"))
    words = runs.where(F.length("run") >= least_chars).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if slip_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod("h", F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % slip_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, p, s, hi) in the two blocks below theirs: what is shared grows by the first or by the last half of the rest."""
    half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    rest = F.col("m") - F.col("p") - F.col("s") - half
    first = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), F.col("hi").alias("hi"))
    last = F.struct(F.col("p").alias("p"), (F.col("s") + rest).alias("s"), (F.col("p") + half).alias("hi"))
    return rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("at")).select("word", "n", "m", "at.*")


def _shared(rows: DataFrame) -> DataFrame:
    """What the words of a block share: their first p characters, and their last s read backwards."""
    return rows.withColumns({"head": F.substring(F.col("word"), F.lit(1), F.col("p")), "tail": F.substring(F.reverse("word"), F.lit(1), F.col("s"))})


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Of each word with near words: `word`, `n_near` (how many there are), `best` and `best_n` (the most frequent of them)."""
    size = F.length("word")
    least = words.agg(F.min(size).alias("m")).first().m or 0
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= least)
    whole = words.select("word", "n", F.explode(lengths).alias("m")).select("word", "n", "m", F.lit(0).alias("p"), F.lit(0).alias("s"), (F.col("m") + 1).alias("hi"))
    rows = _halves(whole)
    small = []
    while True:
        rows = stage(_shared(rows), "blocks")
        hot = stage(rows.groupBy(*SORTED).count().where((F.col("count") > block) & (F.col("m") - F.col("p") - F.col("s") > 1)).drop("count"), "hot-blocks")
        if hot.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(hot, SORTED, "left_anti").select(*rows.columns))
        rows = _halves(rows.join(hot, SORTED, "left_semi"))
    met = small[0]
    for more in small[1:]:
        met = met.unionByName(more)
    dealt = met.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED).select("word", "n", *PLACE, F.xxhash64(*SORTED).alias("block"))
    found = dealt.mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of blocks; all whole blocks of a batch are compared together, what is cut by its end waits for the next."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        keys = [rows.column(k).to_numpy() for k in [*PLACE, "block"]]
        change = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        starts = np.append(0, np.flatnonzero(change) + 1)
        if len(starts) > 1:
            yield from _near(rows.slice(0, int(starts[-1])), starts[:-1])
        held = rows.slice(int(starts[-1]))
    if held is not None and held.num_rows > 1:
        yield from _near(held, np.array([0]))


def _near(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near words within blocks that start at these rows."""
    rows = rows.combine_chunks()
    words = np.array(rows.column("word").to_pylist(), object)
    n, m, p, hi = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "m", "p", "hi"))
    ends = np.repeat(np.append(starts[1:], len(words)), np.diff(np.append(starts, len(words))))
    width = int(m.max()) + 1
    if len(starts) > 1 and width * len(words) > 4 * COMPARED_BYTES:  # rows are in order of length: short words before long ones
        half = len(starts) // 2
        for part in (slice(0, half), slice(half, None)):
            lo, up = int(starts[part][0]), int(starts[half]) if part.start == 0 else len(words)
            yield from _near(rows.slice(lo, up - lo), starts[part] - lo)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words.tolist()).encode("latin-1"), np.uint8)
    column = np.arange(width)
    ahead, back = np.zeros((2, len(words), width), np.uint8)
    ahead[column < sizes[:, None]] = flat
    back[column >= width - sizes[:, None]] = flat  # right-aligned: equal ends of words stand in equal columns
    back = back[:, ::-1]
    pairs = []
    at = np.arange(len(words))
    for step in range(1, len(words)):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        least = np.minimum(sizes[at], sizes[at + step])
        some = at[least == m[at]]
        for i in np.array_split(some, max(1, len(some) * width // COMPARED_BYTES)):
            j = i + step
            longer = sizes[i] != sizes[j]
            # Distinct words differ in some column: the longer of two has a character where the other has none.
            same_ahead = (ahead[i] != ahead[j]).argmax(1)
            same_back = (back[i] != back[j]).argmax(1)
            near = (same_ahead + same_back >= m[i] - ~longer) & (same_ahead >= p[i]) & (same_ahead < hi[i])
            pairs.append(np.stack([i[near], j[near]]))
    found = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
    if not found.size:
        return
    a, b = np.concatenate([found, found[::-1]], 1)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    counts = np.diff(np.append(first, len(a)))
    out = [pa.array(words[a[first]], pa.string()), pa.array(counts), pa.array(n[b[first]]), pa.array(words[b[first]], pa.string())]
    yield pa.RecordBatch.from_arrays(out, ["word", "n_near", "best_n", "best"])


def variants(words: DataFrame, *, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """Each word with `form`, the most frequent near word if it is at least `ratio` times as frequent, and `root`, the last of the forms of forms."""
    words = stage(words.select("word", "n"), "dictionary")
    near = near_words(words, block=block)
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = stage(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
        "forms",
    )
    # Forms are ever more frequent, so following them ends; each round doubles the steps that `root` is away.
    roots = stage(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stage(roots)
        if after.where("moved").isEmpty():
            break
        roots = after.drop("moved")
    return known.join(after.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words share what is left when one of their characters is left out or blanked; the CRC-32 is made from its 256 table entries.
VARIANTS_SQL = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM lowered WHERE length(run) >= 5),
summed AS (SELECT run, coded.n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM places),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts AS a JOIN cuts AS b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM w AS a JOIN cuts AS b ON a.word = b.cut
  UNION SELECT b.word, b.n, a.word, a.n FROM w AS a JOIN cuts AS b ON a.word = b.cut),
ranked AS (SELECT word, n, count(*) AS n_near, min(struct_pack(less := -other_n, other := other)) AS best FROM near GROUP BY word, n),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.other END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM w LEFT JOIN ranked ON w.word = ranked.word),
walk AS (SELECT word, word AS last, 0 AS steps FROM formed UNION ALL SELECT walk.word, form, steps + 1 FROM walk JOIN formed ON walk.last = formed.word WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN (SELECT word, arg_max(last, steps) AS root FROM walk GROUP BY word) USING (word)
"""
