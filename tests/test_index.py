"""Runs of the index over transcripts of files and databases: what is read, what fails, what is kept."""

import json
import os
import sqlite3

from threadlens.streaming.index import index_home, messages_of
from threadlens.streaming.refresh import read_table


def talk(path, session, texts):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"type": "user", "sessionId": session, "message": {"role": "user", "content": t}}) + "\n" for t in texts))


def database(path, sessions):
    """sessions: id -> (time, texts)."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.unlink(missing_ok=True)
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE session(id, directory, title, time_updated); CREATE TABLE message(id, session_id, time_created, data); CREATE TABLE part(id, message_id, time_created, data)")
    for s, (at, texts) in sessions.items():
        db.execute("INSERT INTO session VALUES (?, '/d', 'T', ?)", (s, at))
        for k, t in enumerate(texts):
            db.execute("INSERT INTO message VALUES (?, ?, ?, ?)", (f"{s}-{k}", s, k, json.dumps({"role": "user"})))
            db.execute("INSERT INTO part VALUES (?, ?, ?, ?)", (f"{s}-{k}-p", f"{s}-{k}", k, json.dumps({"text": t})))
    db.commit()
    db.close()


def run(spark, home, target, **options):
    return {os.path.basename(r.source_path): r for r in index_home(spark, str(home), f"file://{target}", buckets=4, **options).collect()}


def texts(spark, target):
    return sorted((r.session_id, r.text) for r in messages_of(read_table(spark, f"file://{target}")).collect())


def test_runs(spark, tmp_path):
    home, target = tmp_path / "home, with+comma", tmp_path / "index"
    claude, db = home / ".claude/projects/p q", home / ".local/share/opencode/opencode.db"
    talk(claude / "a.jsonl", "a", ["one", "two"])
    talk(claude / "b.jsonl", "b", ["three"])
    (claude / "empty.jsonl").write_text("no JSON\n")
    database(db, {"x": (1, ["from x"]), "y": (1, ["from y", "more y"]), "none": (3, [])})
    first = run(spark, home, target)
    assert {n: (r.outcome, r.sessions, r.messages) for n, r in first.items()} == {"a.jsonl": ("read", 1, 2), "b.jsonl": ("read", 1, 1), "empty.jsonl": ("read", 0, 0), "opencode.db": ("read", 3, 3)}
    want = [("a", "one"), ("a", "two"), ("b", "three"), ("x", "from x"), ("y", "from y"), ("y", "more y")]
    assert texts(spark, target) == want

    again = run(spark, home, target)
    assert {r.outcome for n, r in again.items() if n.endswith("jsonl")} == {"unchanged"}
    assert sum(r.messages + r.sessions + r.removed for r in again.values()) == 0 and texts(spark, target) == want

    talk(claude / "b.jsonl", "b", ["three", "four"])
    talk(claude / "new.jsonl", "n", ["five"])
    (claude / "a.jsonl").unlink()
    database(db, {"x": (1, ["not read, as its time is the same"]), "y": (2, ["y anew"]), "z": (1, ["from z"])})
    third = run(spark, home, target)
    assert {n: (r.outcome, r.sessions, r.removed, r.messages) for n, r in third.items()} == {
        "a.jsonl": ("vanished", 0, 0, 0), "b.jsonl": ("read", 1, 0, 2), "new.jsonl": ("read", 1, 0, 1), "empty.jsonl": ("unchanged", 0, 0, 0), "opencode.db": ("read", 2, 1, 2),
    }
    want = [("a", "one"), ("a", "two"), ("b", "four"), ("b", "three"), ("n", "five"), ("x", "from x"), ("y", "y anew"), ("z", "from z")]
    assert texts(spark, target) == want

    db.write_bytes(b"no database at all" * 300)  # keeps its rows; the others go on
    talk(claude / "new.jsonl", "n", ["six"])
    fourth = run(spark, home, target)
    assert fourth["opencode.db"].outcome == "failed" and "DatabaseError" in fourth["opencode.db"].error and fourth["new.jsonl"].outcome == "read"
    assert texts(spark, target) == sorted([w for w in want if w[0] != "n"] + [("n", "six")])

    database(db, {"x": (1, ["x"])})
    run(spark, home, target)
    assert [t for t in texts(spark, target) if t[0] in "xyz"] == [("x", "from x")]
    full = run(spark, home, target, full=True)
    assert "a.jsonl" not in full and texts(spark, target) == [("b", "four"), ("b", "three"), ("n", "six"), ("x", "x")]


def test_nothing_there(spark, tmp_path):
    assert index_home(spark, str(tmp_path), f"file://{tmp_path}/index").count() == 0
    assert read_table(spark, f"file://{tmp_path}/index") is None
