import hashlib
import random
import re
import resource
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from threadlens.llm import bpe, chains, chat, crf, embedding_dedup, materialize, mixing, near_copies, quality_classifier, quality_rules, sharding, simhash, substring
from threadlens.llm.common import stage_path
from threadlens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# With column names that operators use inside.
CLASHING = ("key", "size", "id", "doc", "bucket", "taken", "component", "gone_id", "marked_id", "marked_chunks", "CUT_RESULT", "lookup_slot", "Lookup_Shard", "_lookup_slot")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
rng = random.Random(7)


def words(n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


PASSAGE = words(60)
TEXTS = [words(30), words(200), None, "", " \n\t", words(30), "x", words(5000)] + [words(80) + " " + PASSAGE + "\n" + words(70) for _ in range(4)] + ["né  #a\n" * 40]
TEXTS[5] = TEXTS[0]


def table(spark, texts=TEXTS, sources=("b", "a", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), *CLASHING) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    per, total = {}, sum(size.values())
    for i, n in size.items():
        per[("b", "a", None)[i % 3]] = per.get(("b", "a", None)[i % 3], 0) + n
    weight, target = {"a": 5, "b": 2, None: 1}, {}
    left, open_ = 1.5 * total, set(per)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * per[s]}
        for s in full or open_:
            target[s] = 2.0 * per[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    for s in per:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1 and all(abs(r.target - target[s]) < 1e-6 for r in mine)
    assert all(r["size"] == size[r.id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    copies = mixing.mix_documents(docs).collect()
    taken = {r.id: r.taken for r in rows}
    for i in size:
        assert sum(len(WORD.findall(c.text)) for c in copies if c.doc_id == i) == taken[i]
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_without_ids(spark):
    """Documents without ids and of one size are told apart by their texts; which of them are taken does not hang on the order of rows."""
    texts = [words(20) for _ in range(60)] + ["one and the same text"] * 5
    docs = table(spark, texts, sources=("a", "b")).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mixing.mix(docs).collect()
    assert len({r.key for r in rows}) == 61
    taken, again = (sorted(map(repr, mixing.mix_documents(d, max_epochs=1, total_share=0.4).select("text", "source").collect())) for d in (docs, docs.repartition(5).orderBy(F.rand(3))))
    assert taken == again and 0 < len(taken) < 60


def test_sharding(docs, empty):
    names = [f"s{i}" for i in range(7)]
    table_ = sharding.lookup_table(tuple(names), 101)
    assert max(table_.count(i) for i in range(7)) - min(table_.count(i) for i in range(7)) <= 1
    fewer = sharding.lookup_table(tuple(names[:-1]), 101)
    assert sum(a != b for a, b in zip(table_, fewer, strict=True)) < 50
    rows = sharding.assign_shards(docs, names, table_size=101).collect()
    for r in rows:
        assert r.lookup_slot == "lookup_slot" and r.Lookup_Shard == "Lookup_Shard"
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101 and r.shard == table_[r.slot]
    assert sharding.assign_shards(empty, names).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.assign_shards(nulls, names).count() == len(TEXTS)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a",), 100)


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = bpe.load(path), Tokenizer.from_file(path)
    some = ["", "a", "<|endoftext|>x <|endo", "中文 é́ \x85　'll 12²", "\U0001f600" * 5] + ["".join(rng.choice("ab é中<|>\n '1") for _ in range(40)) for _ in range(300)]
    ids, ends = ours.encode([t.encode() for t in some])
    for text, a, b in zip(some, [0, *ends], ends, strict=False):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want and ours.decode(ids[a:b]) == theirs.decode(want, skip_special_tokens=False)
    rows = bpe.encode_documents(docs, path).collect()
    assert {r.id: r.decoded for r in rows} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_documents(empty, path).count() == 0
    assert ours.decode(np.array([ours.vocab[b"\xff"]])) == "�"


def test_training_order(spark, docs, empty):
    for n in (1, 2, 5, 64, 1000):
        assert sorted(materialize.permuted(np.arange(n), n, "k").tolist()) == list(range(n))
    tokenizer, path = public_tokenizers.path("byte_bpe_50k.tiktoken"), stage_path(spark, "shards")
    note = materialize.write_shards(docs, tokenizer, path, length=64, shard_slots=50)
    rows = sorted(materialize.read_shards(spark, path).collect())
    assert [r.slot for r in rows] == list(range(note["sequences"]))
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(TEXTS):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.part)
        assert sum((list(r.tokens) for r in mine), []) == [*reference.encode(text or "", add_special_tokens=False).ids, note["end"]]
    assert materialize.write_shards(docs, tokenizer, path, length=64, shard_slots=50, resume=True) == note
    assert sorted(materialize.read_shards(spark, path, (30, 120)).collect()) == rows[30:120]
    with pytest.raises(ValueError):
        materialize.write_shards(docs, tokenizer, path, length=32, shard_slots=50, resume=True)
    with pytest.raises(ValueError):  # as many sequences, of other documents
        materialize.write_shards(docs.withColumn("doc_id", F.col("doc_id") + 1), tokenizer, path, length=64, shard_slots=50, resume=True)
    assert materialize.write_shards(empty, tokenizer, stage_path(spark, "shards"))["sequences"] == 0


def brute_components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_components(spark):
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    known = {frozenset(p) for p in pairs}
    label = brute_components(140, lambda i, j: frozenset((i, j)) in known)
    assert all(got.get(i, i) == label[i] for i in range(140))


def slow_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash(spark, docs, empty, tile):
    fps = [slow_fingerprint(t) for t in TEXTS]
    rows = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    label = brute_components(len(TEXTS), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert all(rows[i].fp & (1 << 64) - 1 == fps[i] and rows[i].component == label[i] for i in range(len(TEXTS)))
    near = [0, *(1 << k for k in range(0, 64, 3)), *((1 << 64) - 1 - (1 << k) for k in range(9)), *(rng.getrandbits(64) for _ in range(20))]
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    for blocks in (5, 6):
        links = simhash.close_links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile, blocks=blocks).collect()
        pairs = {frozenset((r.a, r.b)) for r in links}
        ours = brute_components(len(near), lambda i, j: frozenset((signed[i], signed[j])) in pairs)
        assert ours == brute_components(len(near), lambda i, j: (near[i] ^ near[j]).bit_count() <= 4)
    if tile == 4:
        assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(label)


@pytest.mark.parametrize("tile", [1024, 8])
def test_embeddings(spark, tile):
    g = np.random.default_rng(3)
    base = g.standard_normal((20, 16))
    v = [list(map(float, base[i % 20] + 0.12 * g.standard_normal(16))) for i in range(80)]
    v += [v[0], v[0], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15]
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, id int"), tile=tile).collect()
    x = np.array(v[:82])
    cos = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :] >= 0.95
    label = brute_components(82, lambda i, j: cos[i, j])
    got = {r.id: r for r in rows}
    assert len(got) == len(v)
    assert all((got[i].n_links, got[i].component) == (cos[i].sum() - 1, label[i]) for i in range(82))
    assert all((got[i].n_links, got[i].component) == (0, i) for i in range(82, len(v)))


def test_embeddings_of_any_size_and_id(spark):
    """Doubles whose squares over- or underflow, and rows without an id or that share one."""
    small, large = [5e-324, 1e-320, 0.0], [1e300, 2e303, 0.0]
    rows = [(1, small), (2, [2 * c for c in small]), (3, large), (4, [c / 4 for c in large]), (None, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0]), (6, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, -1.0]), (8, [0.0, 0.0, -2.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = [np.array(v) / max(map(abs, v)) for _, v in rows]
    near = [[float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) >= 0.95 for b in unit] for a in unit]
    label = brute_components(len(rows), lambda i, j: near[i][j])
    want = []
    for i, (name, _) in enumerate(rows):
        named = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        want.append((name or 0, sum(near[i]) - 1, min(named, default=0)))
    assert sorted((r.id or 0, r.n_links, r.component or 0) for r in got) == sorted(want)


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_marginals(psi, pairs):
    from itertools import product

    n, total, best = len(psi), np.zeros(len(psi)), (-1.0, None)
    z = 0.0
    for labels in product((0, 1), repeat=n):
        p = np.prod([psi[t][y] for t, y in enumerate(labels)]) * np.prod([pairs[a][b] for a, b in zip(labels, labels[1:], strict=False)])
        z += p
        total += p * np.array(labels)
        best = max(best, (p, labels))
    return total / z, best[1]


def test_field_against_enumeration():
    g = np.random.default_rng(1)
    texts = [b"Some line.\nA | b | c\n\nOTHER!! LINE!!", b"one", b"", b"x x x\ny y\nz\nA b c d e"]
    lines = crf.line_features(texts)
    model = crf.LineModel(np.zeros(crf.FEATURES), np.ones(crf.FEATURES), g.standard_normal(crf.FEATURES), g.standard_normal((2, 2)))
    marginals, labels, at = model.marginals(model.of(lines)), model.viterbi(model.of(lines)), 0
    for k in lines.per_text:
        want, best = brute_marginals(model._emissions(lines.x[at : at + k]), np.exp(model.pairs))
        assert np.allclose(marginals[at : at + k], want) and tuple(labels[at : at + k]) == best
        at += k


def step_by_step(odds, pairs):
    """Marginals and best labels of one chain, place by place, and how far apart the two best labels ever are."""
    psi, n = np.exp(np.stack([-odds / 2, odds / 2], 1)), len(odds)
    alpha, beta, best, back = psi.copy(), np.ones((n, 2)), np.log(psi), np.zeros((n, 2), int)
    for t in range(n):
        if t:
            alpha[t] *= alpha[t - 1] @ np.exp(pairs)
            each = best[t - 1][:, None] + pairs
            back[t], best[t] = each.argmax(0), best[t] + each.max(0)
        alpha[t] /= alpha[t].sum()
    for t in range(n - 1, 0, -1):
        beta[t - 1] = np.exp(pairs) @ (psi[t] * beta[t])
        beta[t - 1] /= beta[t - 1].sum()
    labels = [int(best[-1].argmax())]
    for t in range(n - 1, 0, -1):
        labels.append(int(back[t, labels[-1]]))
    return (alpha * beta)[:, 1] / (alpha * beta).sum(1), labels[::-1]


@pytest.mark.parametrize(("chain", "work"), [(1, 4), (3, 40), (1024, 1 << 18)])
def test_long_chains_in_blocks(monkeypatch, chain, work):
    monkeypatch.setattr(chains, "CHAIN", chain)
    monkeypatch.setattr(chains, "WORK", work)
    g = np.random.default_rng(chain)
    per_chain = np.array([1, 2, 7, 64, 65, 500, 1, 3000, 1025])
    odds, pairs = g.standard_normal(per_chain.sum()) * 3, g.standard_normal((2, 2))
    got, labels, at = chains.marginals(odds, pairs, per_chain), chains.viterbi(odds, pairs, per_chain), 0
    for n in per_chain:
        want, best = step_by_step(odds[at : at + n], pairs)
        assert np.allclose(got[at : at + n], want) and labels[at : at + n].tolist() == best
        at += n


def test_features_of_long_texts_in_pieces(monkeypatch):
    g = random.Random(4)
    text = "\n".join(g.choice(["", "a b", "ÀB c!", "x x | 1", "a b"]) for _ in range(200)).encode()
    for lines in (1, 7, 200, 1000):
        monkeypatch.setattr(crf, "SLICE_LINES", lines)
        x, size = (np.concatenate(c) for c in zip(*crf._features_in_pieces(text), strict=True))
        whole = crf.line_features([text])
        assert np.array_equal(x, whole.x) and np.array_equal(size, whole.size)
        assert [len(p) for p in crf.slices(pa.array([text.decode(), None, "a\nb", "c"]))][0] in (1, 4)


@pytest.mark.parametrize("text", ["\n" * 4_000_000, "ab\nc d\n" * 500_000])
def test_megabytes_of_short_lines(text):
    """Scores, labels and the verdict on a text of millions of lines, in bounded memory and time; nothing depends on the number of lines."""
    g = np.random.default_rng(2)
    model = crf.LineModel(np.zeros(crf.FEATURES), np.ones(crf.FEATURES), g.standard_normal(crf.FEATURES) / 9, g.standard_normal((2, 2)))
    start, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    read = model.read(next(crf.slices(pa.array([text]))))
    good, labels = model.marginals(read), model.viterbi(read)
    assert len(good) == len(labels) == text.count("\n") + 1 and np.isfinite(good).all()
    assert 0 <= model.scores(read)[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kB
    assert time.process_time() - start < 60  # some 10 s on an idle machine


def test_quality(spark, empty):
    good = ["\n".join(words(12).capitalize() + "." for _ in range(rng.randint(2, 9))) for _ in range(120)]
    bad = ["\n".join(" | ".join(words(12).split()) for _ in range(rng.randint(2, 9))) for _ in range(60)] + [("SHOUT!! " * 60).strip() for _ in range(60)]
    texts = good + bad + [None, "", "\n"]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    rows = {r.id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([(rows[i] >= 0.5) == (i < 120) for i in range(240)]) > 0.95
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in rows.items() if s >= 0.5}
    judged = {r.id: r for r in quality_rules.judge(docs, model).collect()}
    assert all(judged[i].base_failed and not judged[i].kept for i in range(240, 243))
    assert all(not judged[i].kept for i in range(120, 240))
    assert all(judged[i].kept for i in range(120) if not judged[i].base_failed)
    for d in (quality_classifier.score(empty, model), quality_rules.judge(empty, model), quality_classifier.keep_good(empty, model)):
        assert d.count() == 0
    many = docs.where("doc_id = 5").crossJoin(spark.range(500).select()).unionByName(docs.where("doc_id <> 5"))
    assert len(crf.sample(many, labels.unionAll(labels))[1]) == 240  # repeated rows are one label each
    bounded = crf.sample(docs, labels, total_lines=100)[0]
    assert 50 < bounded.per_text.sum() <= 100
    unfitted = quality_classifier.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_classifier.score(docs, unfitted).collect()} == {0.5}


def test_chat(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    for t in ("", control, "<\\|a<\\\\|", "<<||"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n\\n")) == t + "\n\\n"
    rows = [(c, i, rng.choice(["user", "assistant", "system", None]), rng.choice([words(20), control, None, ""])) for c in (1, 2, 3, None) for i in range(12)]
    rows += [(9, i, "assistant", words(200)) for i in range(900)] + [(2, 3, "user", "tie"), (2, 3, "user", "tie")]
    events = spark.createDataFrame([(c, t, t, "message", r, x, 1) for c, t, r, x in rows], "conv_id long, message_id long, seq long, kind string, role string, text string, block int")
    blocks = chat.render(chat.fold_events(events))
    assert blocks.where("conv_id = 9").count() > 1
    got = {r.conv_id: r for r in chat.read_back(blocks).collect()}
    for c in (1, 2, 3, 9, None):
        mine = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        want = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 2, 2, "delta", None, "wro"), (1, 2, 3, "delta", None, "ng"), (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, "right"), (1, 1, 6, "edit", None, "hello"), (1, 7, 8, "delta", None, "lone")]
    folded = chat.fold_events(spark.createDataFrame(log, "conv_id long, message_id long, seq long, kind string, role string, text string"))
    assert sorted((r.turn, r.role, r.text) for r in folded.collect()) == [(0, "user", "hello"), (1, "assistant", "right"), (8, "", "lone")]
    assert chat.read_back(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_substrings(spark, docs, empty):
    rows = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    assert len(rows) == len(TEXTS) and rows[8].text == TEXTS[8]
    assert all(rows[i][c] == c for i in (8, 9) for c in CLASHING)
    for i in (9, 10, 11):
        assert PASSAGE not in rows[i].text and len(rows[i].removed_spans) == 1
        a, b = rows[i].removed_spans[0]["start"], rows[i].removed_spans[0]["end"]
        assert TEXTS[i][:a] + TEXTS[i][b:] == rows[i].text
        inside = set(TEXTS[i][a:b].split())
        assert inside <= set(PASSAGE.split()) and len(inside) > 0.5 * len(set(PASSAGE.split()))
    for i in (0, 1, 2, 3, 4, 6, 7):
        assert rows[i].text == TEXTS[i]
    assert rows[5].text == ""  # a copy of document 0
    assert substring.dedup_substrings(empty).count() == 0
    twice = docs.unionAll(docs.where("doc_id = 1"))  # the same row twice is no repetition
    assert [r.text for r in substring.dedup_substrings(twice).where("doc_id = 1").collect()] == [TEXTS[1]] * 2
    moved = substring.chunk_starts([b"inserted words " + PASSAGE.encode()])[0] - 15
    assert len(set(moved.tolist()) & set(substring.chunk_starts([PASSAGE.encode()])[0].tolist())) >= len(moved) - 4


def test_substrings_without_unique_ids(spark):
    """Rows without an id and rows that share one are documents of their own, whatever their lengths."""
    clean, whole = [words(n) for n in (300, 90, 40, 500)], words(50)
    rows = [(None, f"{PASSAGE}\n{clean[0]}"), (None, f"{PASSAGE}\n{clean[1]}"), (None, None), (None, "x"), (None, whole), (None, whole)]
    rows += [(7, clean[2]), (7, f"{clean[3]} {PASSAGE} {words(30)}"), (7, None), (7, "y"), (9, f"{words(80)} {PASSAGE}"), (9, words(25)), (9, clean[2])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = {r.k: r for r in substring.dedup_substrings(docs).collect()}
    assert len(got) == len(rows) and got[2].text is None and got[8].text is None and got[3].text == "x" and got[9].text == "y"
    assert sum(PASSAGE in got[k].text for k in (0, 1)) == 1 and all(clean[k] in got[k].text for k in (0, 1))
    assert sorted(got[k].text for k in (4, 5)) == ["", whole]  # copies, neither of which has an id
    assert got[6].text == clean[2] and got[12].text == "" and got[11].text == rows[11][1]
    assert PASSAGE not in got[7].text and got[7].text.startswith(clean[3][:-10]) and PASSAGE not in got[10].text
    for k, r in got.items():
        for span in r.removed_spans:
            inside = rows[k][1][span["start"] : span["end"]].split()
            known = {*PASSAGE.split(), *whole.split(), *clean[2].split()}
            assert len(inside) >= substring.LEAST_WORDS and set(inside) <= known


def test_near_copies(spark, empty):
    """Copies at similarities around 0.8 to 1, against brute force; ids may be null or repeated."""
    made = [words(200) for _ in range(12)]
    for text in made[:10]:
        for changes in (1, 2, 3, 4, 5):
            w = text.split()
            for at in rng.sample(range(200), changes):
                w[at] = words(1) + "z"
            made.append(" ".join(w))
    made += [made[3].upper(), made[3], "", " ", None, "one two", "one  TWO"]
    sets = []
    for t in made:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    like = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    assert sum(0.8 <= x < 0.9 for r in like for x in r) >= 40 and sum(0.6 < x < 0.8 for r in like for x in r) >= 10
    label = brute_components(len(made), lambda i, j: like[i][j] >= 0.8)
    ids = [None if k % 3 == 1 else k - k % 2 for k in range(len(made))]
    for some in (list(range(len(made))), ids):
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(zip(some, made, strict=True))], "doc_id long, text string, row_number int").repartition(3)
        kept = corpus_pipeline.drop_near_copies(spark, docs, "") if some is ids else near_copies.keep_one(docs, tile=8)
        assert kept.columns == docs.columns
        got = [r.row_number for r in kept.collect()]
        assert sorted(label[k] for k in got) == sorted(set(label))
        if some is not ids:
            assert set(got) == set(label)
    assert corpus_pipeline.drop_near_copies(spark, empty, "").count() == 0


def test_near_copies_are_linked_by_fingerprints(spark):
    """A radius that no fingerprints meet leaves all texts apart, those of one hub too; the usual one joins them."""
    text = words(200).split()
    made = [" ".join([*text[:k], "z", *text[k + 1 :]]) for k in range(20, 180, 20)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert near_copies.keep_one(docs).count() == 1 and near_copies.keep_one(docs, radius=-1).count() == len(made)


def test_training_order_encodes_once(spark, docs):
    """Only the pass that sends the sequences needs the tokenizer; slots leave out the places that no sequence takes."""
    tokenizer, path = public_tokenizers.path("byte_bpe_50k.tiktoken"), stage_path(spark, "shards")
    note = materialize.write_shards(docs, tokenizer, path, length=16, shard_slots=8)
    assert note["places"] == sum(len((t or "").encode()) // 16 + 1 for t in TEXTS) > note["sequences"] == sum(note["counts"])
    # Places come from lengths: no tokenizer is there to be asked.
    assert sum(materialize._places(docs.selectExpr("doc_id AS id", "text"), 16)[0]) == note["places"]
    rows = sorted(materialize.read_shards(spark, path).collect())
    assert [r.slot for r in rows] == list(range(note["sequences"])) and len({(r.doc_id, r.part) for r in rows}) == len(rows)
    at, fs = np.cumsum([0, *note["counts"]]), materialize.open_folder(path)
    assert all(at[r.shard] <= r.slot < at[r.shard + 1] for r in rows)
    for low, high in ((0, 1), (at[3], at[5]), (7, 30), (len(rows) - 1, len(rows) + 5), (5, 5)):
        assert sorted(materialize.read_shards(spark, path, (int(low), int(high))).collect()) == rows[low:high]
    # Shards that are lost or cut are written again, alike.
    cut, lost = (int(s) for s in np.argsort(note["counts"])[-2:])
    with fs[0].open_input_stream(f"{fs[1]}/shard-{cut:08d}.bin") as f:
        head = f.read(16 + 16 * 2)
    with fs[0].open_output_stream(f"{fs[1]}/shard-{cut:08d}.bin") as f:
        f.write(head)
    fs[0].delete_file(f"{fs[1]}/shard-{lost:08d}.bin")
    assert materialize.write_shards(docs, tokenizer, path, length=16, shard_slots=8, resume=True) == note
    assert sorted(materialize.read_shards(spark, path).collect()) == rows
