"""Decisions of transcripts by the exact fold: sentences in order, each confirming, carrying out, repeating or making a decision.

What a sentence is (confirmation, implementation, candidate with its choice, its words) is worked out by expressions, in parallel and
without order. Only such sentences are shuffled, by transcript, and folded in order with a small state. Each sentence goes to the first of

* a confirmation by the user: the latest decision, if it ends no more than three messages back;
* an implementation or test by the assistant: the latest decision that shares a word, among those that end no more than four back;
* a candidate of the same message and choice, or the latest decision of the other role that shares a word and ends no more than two back;
* a new decision.

What is attached moves a decision's end, so distances are counted from there. Looking back stops at the first decision that is too
far, so one that ends more than four messages back, and all before it, can't change any more: it is put out at once, and a task holds
only the decisions since. How long a transcript is makes no difference to memory.

Defined results: messages without text or role make no sentence; messages of equal time are in the order of their ids; repeated messages
repeat their evidence only where the quote or its kind is new; columns beyond those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import decision_patterns as P
from ..functions import text as T
from .decisions import _marked, choice, confidence, decision_id, is_usable_chosen, rationale, reasons, tokens

#: What attachments add to the confidence.
CONFIRMED, IMPLEMENTED = 0.14, 0.08

EVIDENCE = "array<struct<kind string, quote string, at long, role string>>"
FOLDED = f"decision_id string, {{keys}}, message_start long, message_end long, segment string, chosen string, rationale string, options array<string>, confidence double, reasons array<string>, outcome string, evidence {EVIDENCE}, members array<string>"


def sentences_that_count(messages: DataFrame, keys: list[str], *, least: float = P.ADMITTED_FROM, resolved_only: bool = False) -> DataFrame:
    """The sentences that confirm, implement or decide, with what the fold needs of each; `made` is the decision made, if any."""
    d = _marked(messages, keys).where("confirms OR implements OR cue")
    d = d.withColumn("c", F.when(F.col("cue"), choice(F.col("segment")))).withColumn("why", F.when(F.col("cue"), rationale(F.col("segment"))))
    facts = (F.col("signal"), F.col("c.options"), F.col("c.chosen"), F.col("why"), F.col("confirms"))
    d = d.withColumn("sure", F.when(F.col("cue"), confidence(*facts)))
    admitted = F.col("cue") & (F.col("sure") >= least)
    if resolved_only:
        admitted = admitted & (F.col("c.chosen") != "") & (F.col("why") != "") & is_usable_chosen(F.col("c.chosen"), F.col("c.options"))
    q = F.col("segment")
    explicit = (F.col("role") == "user") & T.matches(q, P.CONFIRM)
    at = F.col("at").cast("long")
    kinds = F.array_compact(F.array(F.lit("transcript"), F.when(F.col("why") != "", "rationale"), F.when(F.size("c.options") > 0, "alternative"), F.when(explicit, "explicit")))
    made = F.struct(
        decision_id(F.col("session_id"), F.col("at") - 1, F.col("ordinal"), q).alias("decision_id"), F.col("c.options").alias("options"), F.col("c.chosen").alias("chosen"), F.col("why").alias("rationale"),
        F.col("sure").alias("confidence"), reasons(*facts).alias("reasons"), kinds.alias("kinds"), tokens(F.concat_ws(" ", q, F.col("c.chosen"), F.col("why"), F.array_join("c.options", " "))).alias("about"),
        F.transform("c.options", tokens).alias("option_words"), tokens(F.col("c.chosen")).alias("chosen_words"), tokens(F.col("why")).alias("why_words"),
    )
    test, failed = T.matches(q, P.TEST) | T.matches(q, P.TEST_FAIL), T.matches(q, P.TEST_FAIL)
    done = ~T.matches(q, P.NOT_DONE) & ((test & ~failed) | T.matches(q, P.IMPLEMENT))
    return d.select(
        *keys, at.alias("at"), F.col("ordinal").cast("long").alias("ordinal"), "role", q.alias("segment"), "confirms", "implements", F.when(F.col("implements"), test).alias("test"), F.when(F.col("implements"), done).alias("done"),
        F.when(F.col("implements"), tokens(q)).alias("words"), F.when(F.coalesce(admitted, F.lit(False)), made).alias("made"),
    )


@dataclass
class Open:
    """A decision that may still change."""

    row: dict
    start: int
    end: int
    role: str
    about: set[str]
    evidence: list[dict]
    members: list[str]
    outcome: str = "unknown"

    def has(self, quote: str, kind: str) -> bool:
        return any(e["kind"] == kind and e["quote"] == quote for e in self.evidence)

    def attach(self, kind: str, s: dict, gain: float, reason: str) -> None:
        self.evidence.append({"kind": kind, "quote": s["segment"], "at": s["at"], "role": s["role"]})
        self.row["confidence"] = min(1.0, self.row["confidence"] + gain)
        if reason not in self.row["reasons"]:
            self.row["reasons"].append(reason)
        self.end = s["at"]

    def merge(self, other: Open) -> None:
        mine, its = self.row, other.row
        for name, words in (("chosen", "chosen_words"), ("rationale", "why_words")):
            if not mine[name]:
                mine[name] = its[name]
                self.about |= set(its[words])
        for option, words in zip(its["options"], its["option_words"], strict=True):
            if option not in mine["options"]:
                mine["options"].append(option)
                self.about |= set(words)
        self.evidence += [e for e in other.evidence if not self.has(e["quote"], e["kind"])]
        mine["reasons"] += [r for r in its["reasons"] if r not in mine["reasons"]]
        mine["confidence"] = max(mine["confidence"], its["confidence"])
        self.end = max(self.end, other.end)
        self.members += other.members


def _made(s: dict) -> Open:
    row = {**s["made"], "segment": s["segment"], "options": list(s["made"]["options"]), "reasons": list(s["made"]["reasons"])}
    evidence = [{"kind": k, "quote": s["segment"], "at": s["at"], "role": s["role"]} for k in row["kinds"]]
    return Open(row, s["at"], s["at"], s["role"], set(row["about"]), evidence, [row["decision_id"]])


class Fold:
    """The decisions of one transcript that may still change, in the order they were made."""

    def __init__(self) -> None:
        self.open: list[Open] = []
        self.named: dict[tuple[int, str], Open] = {}

    def settled(self, at: int) -> list[Open]:
        """Decisions that no sentence from message `at` on can change; they are let go."""
        far = max((i for i, d in enumerate(self.open, 1) if at - d.end > P.IMPLEMENT_WITHIN), default=0)
        out, self.open = self.open[:far], self.open[far:]
        self.named = {k: d for k, d in self.named.items() if k[0] == at}
        return out

    def confirm(self, s: dict) -> bool:
        if not self.open or s["at"] - self.open[-1].end > P.CONFIRM_WITHIN:
            return False
        if not self.open[-1].has(s["segment"], "explicit"):
            self.open[-1].attach("explicit", s, CONFIRMED, "explicit-confirmation")
        return True

    def implement(self, s: dict) -> bool:
        words = set(s["words"])
        for d in reversed(self.open):
            if s["at"] - d.end > P.IMPLEMENT_WITHIN:
                return False
            if words & d.about:
                kind = "test" if s["test"] else "implementation"
                if not d.has(s["segment"], kind):
                    d.outcome = "implemented" if s["done"] else d.outcome
                    d.attach(kind, s, IMPLEMENTED, "implementation-evidence")
                return True
        return False

    def related(self, new: Open) -> Open | None:
        for d in reversed(self.open):
            if new.start - d.end > P.RELATED_WITHIN:
                return None
            if d.end <= new.start and d.start != new.start and d.role != new.role and d.about & new.about:
                return d
        return None

    def take(self, s: dict) -> None:
        if s["confirms"] and self.confirm(s) or s["implements"] and self.implement(s) or s["made"] is None:
            return
        new = _made(s)
        key = (new.start, new.row["chosen"].lower())
        known = self.named.get(key) or self.related(new)
        if known is not None:
            known.merge(new)
        else:
            self.named[key] = new
            self.open.append(new)


def folded(messages: DataFrame, keys: list[str], **options: object) -> DataFrame:
    """One row per decision: where it starts and ends, what was chosen and why, its evidence, outcome and the sentences in it (`members`).

    The options are those of sentences_that_count().
    """
    return fold(sentences_that_count(messages, keys, **options), keys)


def fold(sentences: DataFrame, keys: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in sentences.schema.fields}
    schema = FOLDED.format(keys=", ".join(f"{k} {kinds[k]}" for k in keys))
    arrow = to_arrow_schema(sentences.sparkSession.createDataFrame([], schema).schema)

    def put(transcript: tuple, d: Open) -> dict:
        r = d.row
        facts = {c: r[c] for c in ("decision_id", "segment", "chosen", "rationale", "options", "reasons")}
        more = {"message_start": d.start, "message_end": d.end, "confidence": round(r["confidence"], 6), "outcome": d.outcome, "evidence": d.evidence, "members": d.members}
        return {**facts, **dict(zip(keys, transcript, strict=True)), **more}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Fold()
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                transcript = tuple(s[k] for k in keys)
                if transcript != now:
                    out += [put(now, d) for d in state.open]
                    now, state = transcript, Fold()
                out += [put(now, d) for d in state.settled(s["at"])]
                state.take(s)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        yield pa.RecordBatch.from_pylist([put(now, d) for d in state.open], schema=arrow)

    return sentences.repartition(*keys).sortWithinPartitions(*keys, "at", "ordinal").mapInArrow(run, schema)
