"""Each query as registered, on the smallest tables, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from threadlens.llm import crf, embedding_dedup, quality_classifier, sharding
from threadlens.llm.queries import ORACLES, QUERIES, SHARDS

from .test_llm import step_by_step

TABLES = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, name, folder=TABLES):
    return QUERIES[name](spark, folder).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(n)]


def sql(name, folder=TABLES):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = db.execute(ORACLES[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    columns, want = sql(name)
    got = QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda row: repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))
    assert sorted(plain(r[c] for c in columns) for r in got.collect()) == sorted(map(plain, want))


def test_op2(spark, texts):
    ids = sorted(texts)
    fps = []
    for i in ids:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i] or ""))
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else [], np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int) if len(h) else np.zeros(64, int)
        fps.append(sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(h))))
    label = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op2_simhash_near_dedup")}
    assert got == {d: (f"{fps[k]:016x}", ids[label[k]]) for k, d in enumerate(ids)}


def test_op3(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = {r.doc_id: r for r in rows(spark, "op3_quality_scores", LARGER)}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(got[d].predicted, q) for d, q in labels.items() if d in got and q in (0, 1) and got[d].held_out]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) >= 0.97
    small = rows(spark, "op3_quality_scores")
    assert sorted(r.doc_id for r in small) == sorted(texts)


def test_op5(spark, texts):
    """Every word that is cut is part of three words in a row that stand elsewhere, too; 60 words in a row stay in one document."""
    got = {r.doc_id: r for r in rows(spark, "op5_substring_dedup")}
    assert sorted(got) == sorted(texts)
    split = {d: WORD.findall(t or "") for d, t in texts.items()}
    windows = Counter(tuple(w[i : i + 3]) for w in split.values() for i in range(len(w) - 2))
    for d, r in got.items():
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        kept, at = [], 0
        for a, b in spans:
            cut = WORD.findall(texts[d][a:b])
            assert len(cut) >= 20
            covered = {i + k for i in range(len(cut) - 2) if windows[tuple(cut[i : i + 3])] > 1 for k in range(3)}
            assert len(covered) == len(cut)
            kept.append(texts[d][at:a])
            at = b
        assert r.n_spans == len(spans) and r.removed_chars == sum(b - a for a, b in spans)
        assert "".join([*kept, (texts[d] or "")[at:]]) == (r.text or "")
    # One word over and over is a single chunk, so only what several documents share is counted.
    before, after = ({d: {tuple(w[i : i + 60]) for i in range(len(w) - 59)} for d, w in some.items()} for some in (split, {d: WORD.findall(r.text or "") for d, r in got.items()}))
    shared = [sum(n - 1 for n in Counter(w for s in some.values() for w in s).values()) for some in (before, after)]
    assert shared[0] > 0 and shared[1] == 0


def test_op6(spark, texts):
    table = sharding.lookup_table(SHARDS, 65537)
    for r in rows(spark, "op6_shard_documents"):
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 65537 and r.shard == table[r.slot]


def test_op7(spark, texts):
    got = rows(spark, "op7_write_training_order")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = 50256  # the id that ends a document
    want = {}
    for d, t in texts.items():
        special = re.split(r"(<\|endoftext\|>)", t or "")
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids if len(special) == 1 else None
        if ids is not None:
            ids = [*ids, end]
            want |= {(d, k): ids[at : at + 512] for k, at in enumerate(range(0, len(ids), 512))}
    mine = {(r.doc_id, r.part): r for r in got}
    assert sorted(r.slot for r in got) == list(range(len(got))) and len(mine) == len(got)
    for key, ids in want.items():
        assert (mine[key].n_tokens, mine[key].tokens_sha256) == (len(ids), sha(",".join(map(str, ids))))
    slots = [r.slot for r in sorted(got, key=lambda r: (r.doc_id, r.part))]
    assert np.mean(np.diff(slots) > 0) < 0.7  # a random order, not the table's


def test_op8(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in rows(spark, "op8_bpe_encode_decode"):
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_op9(spark):
    """All links of the table by brute force, and the recall of the queries that the contract names."""
    found = spark.read.parquet(f"{LARGER}/embeddings.parquet").collect()
    good = [r for r in found if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    x = np.array([r.embedding for r in good], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= embedding_dedup.COSINE
    label = joined(len(good), zip(*np.nonzero(near), strict=True))
    names = [min(good[k].vec_id for k in np.flatnonzero(np.array(label) == label[i])) for i in range(len(good))]
    want = {r.vec_id: (r.vec_id, 0) for r in found} | {r.vec_id: (names[i], int(near[i].sum()) - 1) for i, r in enumerate(good)}
    got = {r.vec_id: r for r in rows(spark, "op9_embedding_near_dedup", LARGER)}
    asked = [v for v in want if v % 50 == 0]
    links = sum(want[v][1] for v in asked)
    assert sum(min(got[v].n_links, want[v][1]) for v in asked) >= 0.9 * links and all(got[v].n_links <= want[v][1] for v in want)
    assert sum(got[v].n_links for v in want) >= 0.999 * sum(n for _, n in want.values())
    if all(got[v].n_links == want[v][1] for v in want):
        assert all(got[v].component_id == want[v][0] and got[v].kept == (v == want[v][0]) for v in want)


def test_op9_recall_on_planted_links(spark):
    """Pairs right above the threshold, in enough vectors for several bits: at least 0.9 must be found; at most one in a thousand is lost."""
    g = np.random.default_rng(8)
    base = g.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = g.standard_normal((1500, 32))
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    angle = math.acos(0.9503)
    pairs = math.cos(angle) * base + math.sin(angle) * other
    v = [(i, list(map(float, r))) for i, r in enumerate(np.concatenate([base, pairs]))]
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>"), tile=512).collect()}
    assert sum(got[i] >= 1 for i in range(1500)) >= 1498


def test_op10(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op10_quality_rules")}
    assert sorted(got) == sorted(texts)
    for d, t in texts.items():
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_scores_and_verdicts_line_by_line(spark, texts):
    """op3's scores and op10's verdicts from the fitted weights, each text's chain walked place by place."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{TABLES}/labels.parquet"))
    scores = {r.doc_id: r.score for r in rows(spark, "op3_quality_scores")}
    judged = {r.doc_id: r for r in rows(spark, "op10_quality_rules")}
    for d, t in texts.items():
        lines = crf.line_features([(t or "").encode()])
        good, labels = step_by_step(model._odds(lines.x), model.pairs)
        weight = lines.size + 1.0
        share = min(max((good * weight).sum() / weight.sum(), 1e-6), 1 - 1e-6)
        a, b = model.scale
        assert abs(scores[d] - 1 / (1 + math.exp(-(a * math.log(share / (1 - share)) + b)))) < 1e-9
        content = (np.array(labels) * weight).sum() / weight.sum()
        assert abs(judged[d].content_share - content) < 1e-9 and judged[d].kept == (not judged[d].base_failed and content >= 0.5)


def test_held_out_labels_are_not_learned(spark):
    """The labels of held-out rows change nothing."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "quality")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    one, other = (quality_classifier.train(docs, x) for x in (labels, turned))
    assert np.array_equal(one.weights, other.weights) and one.scale == other.scale
