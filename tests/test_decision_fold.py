"""The fold of decisions against one over whole lists, on random talks, and by hand."""

import os
import random

import pytest

from threadlens.functions import decision_patterns as P
from threadlens.operators import decision_fold, decisions

from threadlens.plans.decision_queries import talk
from threadlens.plans.queries import QUERIES

from .test_reference import made

TABLES = "/root/testdata/sf0.001"
KEYS = ["tool", "session_id"]
LINES = [
    "We choose SQLite over Postgres because it is simple.", "We picked Redis instead of Kafka since it is fast enough.", "I recommend SQLite. We choose SQLite over MySQL because it is small.", "Let's use Redis because it is fast.",
    "Implemented the SQLite storage.", "All tests passed for the SQLite storage.", "The Redis tests failed.", "Implemented the Kafka reader in store/queue.go.", "Yes, go ahead.", "Looks good, thanks.", "Nothing new.", "Nothing here.", "Hm.",
    "We decided to use SQLite instead of Kafka because Redis is slow. Implemented the Redis cache.", "Yes, we choose Kafka over Redis because it keeps order.",
]


def whole_list(sentences):
    """The decisions of one transcript, over a list that is never cut; the same kinds of rows as fold() gives."""
    found = []
    by_key = {}
    for s in sentences:
        words = set(s["words"] or [])
        last = None
        if s["confirms"] and found and s["at"] - found[-1]["end"] <= 3:
            last, kind, gain, reason = found[-1], "explicit", 0.14, "explicit-confirmation"
        if last is None and s["implements"]:
            for d in found[::-1]:
                if s["at"] - d["end"] > 4:
                    break
                if words & d["about"]:
                    last, kind, gain, reason = d, "test" if s["test"] else "implementation", 0.08, "implementation-evidence"
                    break
        if last is not None:
            if (kind, s["segment"]) not in [e[:2] for e in last["evidence"]]:
                last["evidence"].append((kind, s["segment"], s["at"]))
                last["confidence"] = min(1, last["confidence"] + gain)
                last["reasons"] += [reason] * (reason not in last["reasons"])
                last["end"] = s["at"]
                if s["implements"] and s["done"] and kind != "explicit":
                    last["outcome"] = "implemented"
            continue
        m = s["made"]
        if m is None:
            continue
        new = {
            "id": m["decision_id"], "start": s["at"], "end": s["at"], "role": s["role"], "about": set(m["about"]), "chosen": m["chosen"], "rationale": m["rationale"], "options": list(m["options"]), "reasons": list(m["reasons"]),
            "confidence": m["confidence"], "outcome": "unknown", "evidence": [(k, s["segment"], s["at"]) for k in m["kinds"]], "members": [m["decision_id"]],
        }
        target = by_key.get((s["at"], m["chosen"].lower()))
        if target is None:
            for d in found[::-1]:
                if s["at"] - d["end"] > 2:
                    break
                if s["at"] >= d["end"] and d["start"] != s["at"] and d["about"] & new["about"] and d["role"] != s["role"]:
                    target = d
                    break
        if target is None:
            by_key[s["at"], m["chosen"].lower()] = new
            found.append(new)
            continue
        if not target["chosen"]:
            target["chosen"] = m["chosen"]
            target["about"] |= set(m["chosen_words"])
        if not target["rationale"]:
            target["rationale"] = m["rationale"]
            target["about"] |= set(m["why_words"])
        for o, w in zip(m["options"], m["option_words"], strict=True):
            if o not in target["options"]:
                target["options"].append(o)
                target["about"] |= set(w)
        target["evidence"] += [e for e in new["evidence"] if e[:2] not in [x[:2] for x in target["evidence"]]]
        target["reasons"] += [r for r in new["reasons"] if r not in target["reasons"]]
        target["confidence"] = max(target["confidence"], new["confidence"])
        target["end"] = max(target["end"], new["end"])
        target["members"] += new["members"]
    return found


def test_fold_equals_one_over_whole_lists(spark):
    g = random.Random(11)
    talk = []
    for session in range(40):
        talk += [(f"s{session}", g.choice(["user", "assistant"]), g.choice(LINES)) for _ in range(g.choice([1, 5, 60]))]
    counted = decision_fold.sentences_that_count(made(spark, talk), KEYS).cache()
    rows = {}
    for r in counted.orderBy("session_id", "at", "ordinal").collect():
        rows.setdefault(r.session_id, []).append(r.asDict(recursive=True))
    want = {d["id"]: d for found in rows.values() for d in whole_list(found)}
    got = {r.decision_id: r for r in decision_fold.fold(counted, KEYS).collect()}
    assert sorted(got) == sorted(want) and len(want) > 100
    for i, d in want.items():
        r = got[i]
        assert (r.message_start, r.message_end, r.chosen, r.rationale, r.options, r.reasons, r.outcome, r.members) == (d["start"], d["end"], d["chosen"], d["rationale"], d["options"], d["reasons"], d["outcome"], d["members"])
        assert abs(r.confidence - d["confidence"]) < 1e-6 and [(e.kind, e.quote, e.at) for e in r.evidence] == d["evidence"]
    assert any(len(r.members) > 1 for r in got.values()) and {r.outcome for r in got.values()} == {"implemented", "unknown"}


def test_fold_by_hand(spark):
    said = [LINES[0], "Nothing new.", "Nothing new.", "Implemented the SQLite storage.", "Nothing here.", "Nothing here.", "Nothing here.", "All tests passed for the SQLite storage.", "Yes, go ahead.", "Hm.", "Hm.", "Hm.", "Hm.", "Implemented the SQLite storage again."]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant"]
    row = decision_fold.folded(made(spark, [("s", role, t) for role, t in zip(roles, said, strict=True)]), KEYS).collect()
    # The test is seven messages after the decision but four after the implementation; the last line is five after the confirmation.
    assert len(row) == 1 and (row[0].message_start, row[0].message_end, row[0].outcome, row[0].confidence) == (1, 9, "implemented", 1.0)
    assert [(e.kind, e.at) for e in row[0].evidence] == [("transcript", 1), ("rationale", 1), ("alternative", 1), ("implementation", 4), ("test", 8), ("explicit", 9)]
    assert decision_fold.folded(made(spark, [("s", "user", "x")]).limit(0), KEYS).count() == 0


def test_state_stays_small(spark):
    """A transcript of decisions without end: what is open at any time are those of the last messages."""
    talk = made(spark, [("s", ("user", "assistant")[k % 2], LINES[k % len(LINES)]) for k in range(400)])
    state, most = decision_fold.Fold(), 0
    for r in decision_fold.sentences_that_count(talk, KEYS).orderBy("at", "ordinal").collect():
        state.settled(r.at)
        state.take(r.asDict(recursive=True))
        most = max(most, len(state.open))
    assert most <= 2 * (P.IMPLEMENT_WITHIN + 1)
    assert decisions.candidates(talk, KEYS).count() > 100


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the tables")
def test_query(spark):
    rows = {}
    for r in decision_fold.sentences_that_count(talk(spark, TABLES), KEYS).orderBy(*KEYS, "at", "ordinal").collect():
        rows.setdefault((r.tool, r.session_id), []).append(r.asDict(recursive=True))
    want = {(d["id"], d["start"], d["end"], d["chosen"], round(d["confidence"], 6), d["outcome"], len(d["evidence"]), "|".join(d["members"])) for found in rows.values() for d in whole_list(found)}
    got = QUERIES["decisions_folded"](spark, TABLES).collect()
    assert {(r.decision_id, r.message_start, r.message_end, r.chosen, r.confidence, r.outcome, r.n_evidence, r.members) for r in got} == want and len(got) == len(want) > 5
