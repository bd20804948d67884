import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import commits, decisions, skills
from threadlens.sources.gitlog import read_git_log

from .test_reference import MESSAGE, made

KEYS = ["tool", "session_id"]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_sentences(spark):
    cases = {
        "One. Two! 三。Four; five\nsix": ["One.", "Two!", "三。", "Four;", "five", "six"],
        "a `x.y` b. ```c. d``` e": ["a `x.y` b.", "```c. d``` e"],
        "see [it](http://a.b/(c.d)e.f) now. end": ["see [it](http://a.b/(c.d)e.f) now.", "end"],
        "It is slow. So we use Rust. Done": ["It is slow. So we use Rust.", "Done"],
        "它很慢。因此采用 Rust。完": ["它很慢。因此采用 Rust。", "完"],
        "**A heading. With a stop**": ["**A heading. With a stop**"],
        "list[0] and `open": ["list[0] and `open"],
        " \n ": [], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", decisions.sentences(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases
    long = spark.createDataFrame([("[x] `a` " * 40_000,), ("w" * 500_000,), ("](" * 50_000,)], "t string")
    assert [len(r.s) for r in long.select(decisions.sentences(F.col("t")).alias("s")).collect()] == [1, 1, 1]


@pytest.mark.parametrize(
    "text, options, why",
    [
        ("We choose SQLite over Postgres because it is simple.", ["SQLite", "Postgres"], "it is simple"),
        ("Instead of YAML, use TOML.", ["use TOML", "YAML"], ""),
        ("使用 Rust，而非 Go，因为更快。", ["Rust", "Go"], "更快"),
        ("Use Redis or Memcached or Kafka for it.", ["Redis", "Memcached", "Kafka for it"], ""),
        ("Startup is slow, so we switch to Bun.", ["Bun"], "Startup is slow"),
        ("Do not use Perl here.", [], ""),
    ],
)
def test_choices(spark, text, options, why):
    r = spark.createDataFrame([(text,)], "t string").select(decisions.choice(F.col("t")).alias("c"), decisions.rationale(F.col("t")).alias("w")).first()
    assert (r.c.options, r.c.chosen, r.w) == (options, options[0] if options else "", why)


def test_decisions(spark):
    talk = made(
        spark,
        [
            ("a", "user", "We choose SQLite over Postgres because it is simple."), ("a", "assistant", "Noted that for you."), ("a", "user", "Looks good."), ("a", "user", "Proceed."),
            ("a", "assistant", "I implemented the SQLite storage."), ("b", "user", "Looks good."), ("b", "assistant", "Should we use Go?"), ("b", "assistant", "I might choose Zig because it is small."),
            ("b", "assistant", "We choose Rust over Go because it is safe."), *[("b", "assistant", "filler text")] * 4, ("b", "user", "Approved."), ("b", "user", "Proceed."),
        ],
    )
    found = decisions.candidates(talk, KEYS)
    got = {r.session_id: r for r in found.collect()}
    assert set(got) == {"a", "b"} and got["a"].chosen == "SQLite" and got["a"].confidence == round(0.54 + 0.13 + 0.08 + 0.1, 6)
    assert got["b"].chosen == "Rust" and got["b"].decision_id.startswith("decision-")
    yes = decisions.confirmations(talk, found, KEYS).collect()
    assert [(r.decision_id, r.quote) for r in sorted(yes, key=lambda r: r.at)] == [(got["a"].decision_id, "Looks good."), (got["a"].decision_id, "Proceed.")]
    done = decisions.implementations(talk, found, KEYS).collect()
    assert [(r.decision_id, r.kind, r.outcome) for r in done] == [(got["a"].decision_id, "implementation", "implemented")]
    assert decisions.candidates(spark.createDataFrame([], MESSAGE), KEYS).count() == 0


def test_noise_messages(spark):
    """A message with a mark of noise goes as a whole, and the others keep their places."""
    said = "We choose SQLite over Postgres because it is simple."
    noise = [
        f"{said} </proposed_plan> ok", f"{said}\n[bash-stdout] x", f"{said}\nSee <instructions> here.", f"{said}\n# AGENTS.md for this", f"{said}\n  ignore previous words",
        f" \u00a0tool.call x\n{said}", f"<tool run>\n{said}", f"[/tool:x]\n{said}", "WE CHOOSE SQLITE OVER POSTGRES: IT IS SIMPLE", "DO CHOOSE SQLITE OVER POSTGRES NOW",
    ]
    plain = [said, f"{said} AGENTS.md is read.", f"{said}\nA tool.call is made.", "CHOOSE SQLITE OVER POSTGRES NOW", "USE SQL: NOW", f"AN API: {said}"]
    talk = made(spark, [("a", "user", t) for pair in zip(noise, [*plain, *plain], strict=False) for t in pair])
    found = decisions.segments(talk, KEYS).collect()
    assert {r.at for r in found} == {2 * k + 2 for k in range(len(noise))}
    assert {r.at for r in decisions.candidates(talk, KEYS).collect()} == {2, 4, 6, 8, 12, 14, 16, 18, 20}


def test_evidence(spark):
    talk = made(spark, [("a", "user", "the quick brown fox"), ("a", "assistant", "jumps over the dog")])
    asked = [(1, "transcript", "quick brown", 1, "ok"), (2, "transcript", "quick brown", 2, "not_found"), (3, "explicit", "jumps over", 0, "wrong_role"), (4, "explicit", "quick brown", 0, "ok"), (5, "transcript", " short ", 0, "too_short"), (6, "test", "never said so", 0, "not_found"), (7, "test", None, None, "too_short")]
    rows = spark.createDataFrame([(i, "codex", "a", k, q, at) for i, k, q, at, _ in asked], "evidence_id long, tool string, session_id string, kind string, quote string, at int")
    assert dict(rows_of(decisions.check_evidence(rows, talk, KEYS))) == {i: o for i, *_, o in asked}


def test_evidence_anywhere(spark):
    """Quotes that name no message, with and without white space in them, against a search of every message."""
    rng = random.Random(5)
    said = [("ab", "user", "".join(rng.choices("abcd 好\u00a0\n😀e\u0301", weights=[6, 6, 6, 6, 5, 3, 1, 2, 2, 2, 2], k=rng.randint(0, 60)))) for _ in range(60)]
    talk = made(spark, [("a", "user" if i % 2 else "assistant", t) for i, (_, _, t) in enumerate(said)])
    quotes = []
    for _, _, text in said:
        for _ in range(4):
            start = rng.randint(0, len(text))
            quotes.append(text[start : start + rng.randint(8, 30)] + ("x" if rng.random() < 0.2 else ""))
    kinds = [rng.choice(["explicit", "transcript"]) for _ in quotes]
    rows = [(i, "codex", "a" if i % 9 else "nobody", k, q, 0 if i % 2 else None) for i, (k, q) in enumerate(zip(kinds, quotes, strict=True))]

    def outcome(kind, quote, session):
        if len(quote.strip()) < 8:
            return "too_short"
        roles = {"user" if i % 2 else "assistant" for i, (_, _, t) in enumerate(said) if quote in t and session == "a"}
        return "not_found" if not roles else "wrong_role" if kind == "explicit" and "user" not in roles else "ok"

    frame = spark.createDataFrame(rows, "evidence_id long, tool string, session_id string, kind string, quote string, at int")
    want = {i: outcome(k, q, s) for i, _, s, k, q, _ in rows}
    assert dict(rows_of(decisions.check_evidence(frame, talk, KEYS))) == want
    assert set(want.values()) == {"ok", "too_short", "not_found", "wrong_role"}
    assert decisions.check_evidence(frame.limit(0), talk, KEYS).count() == 0


def test_commits(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("\x1eh1\x1fs1\x1fFirst\x1fAnn\x1f2024-01-01T00:00:00Z\n\nsrc/b.py\nsrc/a.py\nsrc/a.py\n\x1ebroken\n\x1eh2\x1fs2\x1fSecond\x1fBob\x1f2024-01-02T00:00:00Z\n\ndocs\n")
    c = read_git_log(spark, str(log))
    assert sorted((r.hash, r.subject, r.paths) for r in c.collect()) == [("h1", "First", ["src/a.py", "src/b.py"]), ("h2", "Second", ["docs"])]
    wanted = spark.createDataFrame([(1, "./src"), (2, "src/a.py"), (3, "sr"), (4, "docs/x.md"), (5, None)], "decision_id long, path string")
    touched = c.select("hash", F.explode("paths").alias("path"))
    assert sorted(rows_of(commits.path_overlaps(wanted, touched))) == [(1, "h1"), (2, "h1"), (4, "h2")]
    asked = spark.createDataFrame([("s1",), ("h1",), ("zz",)], "asked string")
    assert sorted(rows_of(commits.select_commits(c, asked)), key=str) == [("h1", "h1"), ("s1", "h1"), ("zz", None)]


def test_slugs(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (4, "a-2"), (5, "b"), (6, "b"), (7, "c" * 64), (8, "c" * 64)]
    used = spark.createDataFrame([("b",), ("b-3",)], "slug string")
    got = dict(rows_of(skills.unique_slugs(spark.createDataFrame(rows, "id long, slug string"), used, ["id"]).select("id", "slug")))
    assert got == {1: "a", 2: "a-3", 3: "a-4", 4: "a-2", 5: "b-2", 6: "b-4", 7: "c" * 64, 8: "c" * 62 + "-2"}


def test_bundles(spark):
    talk = made(spark, [("a", "user", "Document the release workflow."), ("a", "assistant", "pytest: all passed"), ("a", "user", "perfect, thanks"), ("b", "user", "部署")])
    got = {r.session_id: r for r in skills.markdown(skills.bundles(talk, KEYS)).collect()}
    assert (got["a"].slug, got["a"].trigger) == ("document-the-release-workflow", "Use when the user asks to Document the release workflow.")
    assert got["b"].slug.startswith("skill-") and len(got["b"].slug) == 14 and "insufficient success evidence" in got["b"].risks
    assert got["a"].document.startswith('---\nname: document-the-release-workflow\ndescription: "Use when')
