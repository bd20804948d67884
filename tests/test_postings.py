"""Searches by postings find what searches of all texts find, before and after changes."""

import random

from pyspark.sql import functions as F

from threadlens.operators import postings
from threadlens.operators.search import And, Near, Not, Or, Phrase, Term, search
from threadlens.streaming.refresh import read_table

from .test_reference import made

WORDS = ["alpha", "beta", "Gamma", "délta", "naïve", "on-the", "x_y", "部署服务", "ab", "-", "alphabet", "the end", "İstanbul", "straße"]
CONDITIONS = [
    Term("alpha"), Phrase("alpha beta"), Near(Term("gamma"), Term("delta")), Near(Term("gamma"), Not(Term("delta"))), And(Or(Term("naive"), Term("部署服")), Term("beta")), Or(Term("ab"), Term("gamma")), Term("on-the"),
    Not(Term("alpha")), Term("a"), Phrase("THE END alpha"), Near(Near(Term("alpha"), Term("beta")), Term("délta")), Term("straße"), Term("zzz"), Term("x_y"), Not(Not(Term("beta"))), Term("lph"), None,
]


def talk(spark, seed, n=120):
    g = random.Random(seed)
    return made(spark, [(f"s{g.randint(0, 40)}", g.choice(["user", "assistant", "system"]), " ".join(g.choices(WORDS, k=g.randint(0, 5)))) for _ in range(n)])


def same(spark, messages, target, condition):
    got, want = (sorted(map(str, df.collect())) for df in (postings.indexed_search(spark, messages, target, condition, limit=1000), search(messages, condition, limit=1000)))
    return got == want


def test_searches_by_postings(spark, tmp_path):
    target = f"file://{tmp_path}/postings"
    messages = talk(spark, 1).cache()
    assert postings.build(messages, target, sessions=10) > 1
    for condition in CONDITIONS:
        assert same(spark, messages, target, condition), condition
    table = read_table(spark, target)
    assert postings.candidate_sessions(table, Not(Term("alpha"))) is None and postings.candidate_sessions(table, Or(Term("ab"), Term("gamma"))) is None
    assert postings.candidate_sessions(table, Term("zzz")).count() == 0
    assert 0 < postings.narrowed(messages, table, Phrase("THE END alpha")).count() < messages.count() / 2


def test_changes_of_sessions(spark, tmp_path):
    target = f"file://{tmp_path}/postings"
    messages = talk(spark, 2)
    parts = postings.build(messages, target, sessions=10)
    later = messages.where("session_id NOT IN ('s1', 's2')").unionByName(messages.where("session_id = 's1'").withColumn("text", F.lit("zzz anew"))).cache()
    postings.update(later, messages.where("session_id IN ('s1', 's2')"), target, 1, parts=parts)
    for condition in (Term("zzz"), Term("alpha"), Near(Term("gamma"), Term("beta"))):
        assert same(spark, later, target, condition), condition
    fresh, kept = (df.select("gram", "part", "keys").collect() for df in (postings.postings(later, parts), read_table(spark, target)))
    assert sorted(map(str, fresh)) == sorted(map(str, kept))


def test_edges(spark, tmp_path):
    rows = made(spark, [("s", "user", "x"), ("t", "user", "long enough text")]).withColumn("text", F.when(F.col("session_id") == "t", F.col("text")))
    assert postings.postings(rows.withColumn("key", F.lit("clash")), 1).count() > 0  # enough characters with the spaces round words
    assert postings.postings(rows.where("session_id = 's'"), 1).count() == 0 and postings.postings(rows.limit(0), 1).count() == 0
    target = f"file://{tmp_path}/none"
    assert postings.indexed_search(spark, rows, target, Term("x")).count() == 1
