"""Sketches, alignment of tokenizers and spelling variants: queries and operators against brute force, and their edge cases."""

import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlens.llm import alignment, bpe, sketches, spelling
from threadlens.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Sketches ------------------------------------------------------------------------------------------------------------------------------


def hashes(spark, texts):
    """The hashes of all shingles of each text, by Spark's own hash of each shingle."""
    rows = []
    for t in set(texts):
        w = [x for x in (t or "").lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        rows += [(t, w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    found = {t: set() for t in texts}
    for r in spark.createDataFrame(rows, "t string, s array<string>").select("t", F.xxhash64("s").alias("h")).collect() if rows else []:
        found[r.t].add(r.h)
    return found


def sketch_of(all_hashes):
    some = sorted(all_hashes)
    low = [h for h in some if h < sketches.THRESHOLD]
    return low if len(low) >= sketches.LEAST else some[: sketches.LEAST]


def like(a, b):
    limit = min((1 << 63) - 1 if len(s) < sketches.LEAST else max(sketches.THRESHOLD, s[-1]) for s in (a, b))
    a, b = ({h for h in s if h <= limit} for s in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


@needs_tables
def test_op11(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    ids = sorted(docs)
    after = {d: docs[ids[(i + 1) % len(ids)]] for i, d in enumerate(ids)}
    edited = {d: docs[d][: len(docs[d]) - len(docs[d]) // 2] + after[d][: len(docs[d]) // 2] for d in ids}
    known = {t: sketch_of(h) for t, h in hashes(spark, [*docs.values(), *edited.values()]).items()}
    digits = lambda s: "".join(f"{h % (1 << 64):016x}" for h in s)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_document_fingerprints"](spark, TABLES).collect()}
    assert got == {
        d: (len(docs[d]), sha(edited[d]), digits(known[docs[d]]), digits(known[edited[d]]), like(known[docs[d]], known[edited[d]]), like(known[docs[d]], known[after[d]])) for d in ids
    }


def test_containment_of_a_short_text_in_a_long_one(spark):
    g = random.Random(1)
    word = lambda: "".join(g.choices("abcdefghij", k=6))
    long = [word() for _ in range(20000)]
    half = [*long[9000:9400], *(word() for _ in range(400))]
    rows = spark.createDataFrame([(" ".join(long), " ".join(long[5000:5800]), " ".join(half), " ".join(word() for _ in range(500)))], "a string, part string, half string, other string")
    s = {c: sketches.sketch(F.col(c)) for c in rows.columns}
    found = rows.select(*[sketches.likeness(s["a"], s[c]).alias(c) for c in ("part", "half", "other")], sketches.union(s["part"], s["half"]).alias("u"), sketches.sketch(F.concat_ws(" ", "part", F.lit("."), "half")).alias("w")).first()
    assert found.part == 1 and 0.35 < found.half < 0.65 and found.other == 0
    assert len(set(found.u) & set(found.w)) > 0.9 * len(found.u)


@pytest.mark.parametrize(("n", "part_rows"), [(0, 5), (1, 5), (40, 1), (120, 7), (120, 1000)])
def test_next_document(spark, n, part_rows):
    """Null and repeated ids, repeated rows, a third of all rows the same, clashing names."""
    g = random.Random(n + part_rows)
    rows = [(g.choice([None, *range(-5, n)]), g.choice(["", None, "x", *(f"t{i}" for i in range(n))]), i, "k") for i in range(n)] + [(3, "same", i, "k") for i in range(n // 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, key string").repartition(3).withColumn("t", F.coalesce("text", F.lit("")))
    place = {r.t: r.h for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    key = lambda r: (-(1 << 70) if r[0] is None else r[0], place[r[1] or ""])
    order = sorted({key(r): r[1] or "" for r in rows}.items())
    after = {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}
    got = sketches.with_next(df, ["t"], part_rows=part_rows)
    assert got.columns == [*df.columns, "next"]
    assert sorted((r.part, r.text or "", r.next.t) for r in got.collect()) == sorted((r[2], r[1] or "", after[key(r)]) for r in rows)


def test_sketches_of_empty_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \n",), ("a b",), ("A b",)], "text string")
    got = [r.sketch for r in sketches.fingerprints(rows).collect()]
    assert got[:3] == [[], [], []] and got[3] == got[4] and len(got[3]) == 1
    assert sketches.fingerprints(rows.limit(0)).count() == 0


# Alignment -----------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Both tokenizers' ids with the bytes of each, or None."""
    a, b = libraries
    to_byte = bpe.byte_characters()
    first = a.encode(f" {text}", add_special_tokens=False).ids
    one = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in first]
    other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = f" {text}".encode()
    return (one, other) if text and all(b"".join(x for _, x in side) == whole for side in (one, other)) else None


def brute(libraries, texts):
    found = []
    for text in texts:
        both = tokens(libraries, text or "")
        if both is None:
            found.append(None)
            continue
        spans = []
        for side in both:
            at, mine = 0, []
            for i, raw in side:
                mine.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(mine)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans) for low, cut in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        found.append((*map(len, spans), len(cuts), links, sha(";".join(groups))))
    n = Counter(link for f in found if f for link in set(f[3]))
    top = {}
    for (i, _), count in n.items():
        top[i] = max(top.get(i, 0), count)
    return [(*f[:3], len(f[3]), sum(n[x] == top[x[0]] for x in f[3]), sum(n[x] for x in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


@needs_tables
def test_op12(spark, libraries):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_align_tokenizers"](spark, TABLES).collect()}
    assert got == dict(zip(docs, brute(libraries, list(docs.values())), strict=True))


PARTS = ["the", " ", "  ", "<s>", "</s>", "<|endoftext|>", "▁", "é", "日本", "\t", "\n", "\x00", "a", "Straße", "123", "'s", "　", " ", "🙂", "x" * 70, "<0x41>", "\r", "ﬁ"]


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_alignment(spark, libraries, frequent):
    g = random.Random(frequent)
    texts = [None, "", " ", "  ", " a ", "a▁b", "same", "same", *("".join(g.choices(PARTS, k=g.randint(1, 30))) for _ in range(300))]
    docs = spark.createDataFrame([(i % 290 if i else None, t, i) for i, t in enumerate(texts)], "doc_id int, text string, row int").repartition(5)
    got = Counter(map(tuple, alignment.align_documents(docs, A, B, frequent=frequent).collect()))
    assert got == Counter((i % 290 if i else None, *want) for i, want in enumerate(brute(libraries, texts)))
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=6), max_size=12).map("".join))
def test_words_encode_as_whole_texts(text):
    pieces, whole = alignment.load(A, B).b, sentencepiece.SentencePieceProcessor(model_file=B)
    ids = pieces.encode([f" {text}"])[0]
    if ids is not None and text:
        assert ids.tolist() == whole.encode(text)
    else:
        assert not text or b"".join(map(pieces.bytes.__getitem__, whole.encode(text))) != f" {text}".encode()


# Spelling ------------------------------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("block", [2, 16, 100_000])
def test_near_words(spark, block):
    g = random.Random(block)
    words = {"".join(g.choices("aé", k=g.randint(5, 9))) for _ in range(700)}
    count = {w: g.randint(3, 30) for w in words}
    want = {}
    for w in words:
        if others := [x for x in words if near(w, x)]:
            best = min(others, key=lambda x: (-count[x], x))
            want[w] = (len(others), best, count[best])
    got = spelling.near_words(spark.createDataFrame(list(count.items()), "word string, n long"), block=block).collect()
    assert {r.word: (r.n_near, r.best, r.best_n) for r in got} == want and len(got) == len(want)


def test_forms_of_forms(spark):
    rows = [("house", 100), ("housee", 50), ("houseee", 25), ("houseeee", 12), ("mouse", 200), ("other", 7), ("othes", 4)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {
        "house": ("mouse", "mouse", 2, 200), "housee": ("house", "mouse", 2, 100), "houseee": ("housee", "mouse", 2, 50), "houseeee": ("houseee", "mouse", 1, 25),
        "mouse": (None, "mouse", 1, None), "other": (None, "other", 1, None), "othes": (None, "othes", 1, None),
    }


def test_word_counts_of_edge_cases(spark):
    long = "z" * 40_000
    rows = [(None, None), (1, ""), (2, "Abcde abcde ABCDE abcd ÀÉÎÕÜ"), (None, f"{long} {long} {long}1{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(docs, slip_every=0).collect()}
    assert got == {"abcde": 3, long: 4}
    empty = docs.limit(0)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    assert [r.root for r in spelling.variants(spelling.word_counts(docs, slip_every=0)).orderBy("n").collect()] == ["abcde", long]
