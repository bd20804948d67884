import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

rng = random.Random(11)


def line(n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def test_pipeline(spark, tmp_path):
    passage = line(60)
    good = ["\n".join(line(15) for _ in range(6)) for _ in range(40)]
    texts = good + [good[0]] * 3 + [f"{line(60)}\n{passage}\n{line(60)}" for _ in range(4)] + [" | ".join(line(80).split()) for _ in range(30)]
    n_good = len(good) + 3 + 4
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < n_good), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    # Rejected documents and all copies but the first are gone; the mix takes 1.5 times all words, so every document is there.
    assert kept == set(range(40)) | set(range(43, 47))
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    decoded = {}
    for r in out:
        assert r.round_trip and r.n_tokens == len(r.ids)
        decoded.setdefault(r.doc_id, []).append(reference.decode(list(r.ids)))
    for i in range(40):
        assert max(decoded[i], key=len) == texts[i] and all(texts[i].startswith(t) for t in decoded[i])
    assert [passage in max(decoded[i], key=len) for i in range(43, 47)] == [True, False, False, False]
    words = sum(len(max(t, key=len).split()) for t in decoded.values())
    assert abs(sum(len(t.split()) for ts in decoded.values() for t in ts) - 1.5 * words) <= 2


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing extra columns; every stage but the last keeps the columns."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, taken long, marked_chunks string, left long"
    long = "\n".join(line(15) for _ in range(3000))
    texts = ["\n".join(line(15) for _ in range(6)) for _ in range(20)] + [" | ".join(line(80).split()) for _ in range(20)] + [long, "", None, " \n"]
    rows = [(i, t, None, None if i % 3 else "s", len(t or ""), "g", 1, "m", 2) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1] + " more", "en", "s", None, None, None, None, None)]
    for name, some in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(some, kinds)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks = [(i, int(i < 20), 0) for i in range(40) if some] + [(None, 1, None), (3, None, None)]
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for stage_name, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == [c.split()[0] for c in kinds.split(", ")], stage_name
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
        if some:
            assert {r.doc_id for r in out} >= {*range(20), 40} and not {r.doc_id for r in out} & {*range(20, 40), 41, 42, 43}
        else:
            assert out == []
