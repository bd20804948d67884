"""Session search: conditions over messages, put together in Python and turned into columns.

Conditions are Term, Phrase, And, Or, Not and Near. Near is what adjacent words mean: both sides somewhere in the same session. A
term is found as a run of whole words without regard to case and accents, or, from three characters on, as a part of the text
without regard to case. A term with punctuation means all its words in the same session.

Row conditions cost no shuffle. What a session has is aggregated first and joined back, so a very long session is no single task.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timestamps import format_timestamp
from .sessions import LOGICAL, PHYSICAL, last_rounds, session_rollup

SNIPPETS, SNIPPET_SOURCES, SNIPPET_CHARS = 3, 6, 200


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return And(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Or(self, other)

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Term(Condition):
    value: str


@dataclass(frozen=True)
class Phrase(Condition):
    value: str


@dataclass(frozen=True)
class Not(Condition):
    of: Condition


@dataclass(frozen=True)
class And(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Or(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Near(Condition):
    """Both sides in the same session; if a side has a Not, both in the same message."""

    left: Condition
    right: Condition


def has_not(c: Condition) -> bool:
    return isinstance(c, Not) or isinstance(c, (And, Or, Near)) and (has_not(c.left) or has_not(c.right))


def positive_atoms(c: Condition, sign: bool = True) -> list[Term | Phrase]:
    """Terms and phrases that count for ranking, without repeats; double negation counts."""
    if isinstance(c, (Term, Phrase)):
        return [c] if sign else []
    if isinstance(c, Not):
        return positive_atoms(c.of, not sign)
    return list(dict.fromkeys([*positive_atoms(c.left, sign), *positive_atoms(c.right, sign)]))


def positive_terms(c: Condition) -> list[str]:
    return sorted((a.value for a in positive_atoms(c)), key=len, reverse=True)


def words_of(value: str) -> list[str]:
    return "".join(ch if ch.isalnum() or ch == "_" else " " for ch in value).split()


def is_han(value: str) -> bool:
    return any(unicodedata.name(c, "").startswith("CJK UNIFIED") or unicodedata.name(c, "").startswith("CJK COMPAT") for c in value)


def text_has(text: Column, value: str) -> Column:
    out = F.lit(False)
    if (tokens := T.token_text_of(value)).strip():
        out = out | T.token_text(text).contains(tokens)
    if len(value) >= 3:
        out = out | F.lower(text).contains(value.lower())
    if len(value) < 3 or is_han(value):
        out = out | F.lower(text).contains(value.lower())
    return F.coalesce(out, F.lit(False))


@dataclass
class _Plan:
    rows: DataFrame
    made: dict[Condition, str] = field(default_factory=dict)

    def add(self, c: Condition, column: Column) -> str:
        self.made[c] = name = f"c{len(self.made)}"
        self.rows = self.rows.withColumn(name, column)
        return name

    def in_session(self, names: list[str]) -> str:
        """Whether each of the named flags is set somewhere in the session."""
        flags = self.rows.groupBy(*LOGICAL).agg(F.min(F.lit(True)).alias("_"), *[F.bool_or(n).alias(f"s_{n}") for n in names])
        every = flags.where(" AND ".join(f"s_{n}" for n in names)).select(*LOGICAL, F.lit(True).alias(flag := f"in{len(self.rows.columns)}"))
        self.rows = self.rows.join(every, LOGICAL, "left")
        return flag

    def column(self, c: Condition) -> str:
        if c in self.made:
            return self.made[c]
        if isinstance(c, Term) and len(words := words_of(c.value)) and any(not ch.isalnum() and ch != "_" for ch in c.value):
            names = [self.add(Term(f"\0{c.value}\0{w}"), text_has(F.col("text"), w)) for w in words]
            flag = self.in_session(names)
            some = F.lit(False)
            for n in names:
                some = some | F.col(n)
            return self.add(c, F.coalesce(F.col(flag), F.lit(False)) & some)
        if isinstance(c, (Term, Phrase)):
            return self.add(c, text_has(F.col("text"), c.value))
        if isinstance(c, Not):
            return self.add(c, ~F.col(self.column(c.of)))
        left, right = self.column(c.left), self.column(c.right)
        if isinstance(c, Or):
            return self.add(c, F.col(left) | F.col(right))
        if isinstance(c, And) or has_not(c.left) or has_not(c.right):
            return self.add(c, F.col(left) & F.col(right))
        flag = self.in_session([left, right])
        return self.add(c, (F.col(left) | F.col(right)) & F.coalesce(F.col(flag), F.lit(False)))


def universe(messages: DataFrame, *, tools: list[str] = (), cwds: list[str] = (), after: float | None = None, include_system: bool = False) -> DataFrame:
    rows = messages if include_system else messages.where(F.col("role").isin("user", "assistant"))
    for tool in tools:
        rows = rows.where(F.col("tool") == tool)
    for cwd in cwds:
        rows = rows.where(T.ascii_lower(F.col("cwd")).contains(T.ascii_lower_of(cwd)))
    return rows if after is None else rows.where(F.col("ts") >= after)


def matching_messages(messages: DataFrame, condition: Condition | None, **filters: object) -> tuple[DataFrame, list[str]]:
    """The messages that match, and the names of their flags for the positive atoms."""
    plan = _Plan(universe(messages, **filters))
    if condition is None:
        return plan.rows, []
    match = plan.column(condition)
    return plan.rows.where(match), [plan.column(a) for a in positive_atoms(condition)]


def _ranked(messages: DataFrame, condition: Condition | None, limit: int, filters: dict) -> DataFrame:
    """The best sessions, without what is only shown: matched atoms, then matches, then newest."""
    if limit <= 0:
        raise ValueError("limit must be above 0")
    found, atoms = matching_messages(messages, condition, **filters)
    physical = found.groupBy(*PHYSICAL).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), *[F.bool_or(a).alias(a) for a in atoms])
    # How old a source is follows from all its messages, those that do not match included.
    ages = messages.groupBy(*PHYSICAL).agg(F.min("ts").alias("created"), F.max("ts").alias("updated"))
    matched = sum((F.max(F.col(a).cast("int")) for a in atoms), F.lit(0)) if atoms else F.lit(0)
    return (
        physical.join(ages, PHYSICAL).groupBy(*LOGICAL)
        .agg(
            matched.alias("matched_atoms"),
            F.sum("n").alias("match_count"),
            F.min("created").alias("created"),
            F.max("updated").alias("updated"),
            F.array_sort(F.collect_list(F.struct("first_id", "source_path"))).alias("sources"),
        )
        .orderBy(F.desc("matched_atoms"), F.desc("match_count"), F.desc_nulls_last("updated"), "tool", "session_id")
        .limit(limit)
    )


def _titled(ranked: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds title and cwd; texts are rolled up for the sessions in `ranked` only, which are as few as the limit says."""
    keys = F.broadcast(ranked.select(*LOGICAL))
    rolled = session_rollup(messages.join(keys, LOGICAL, "left_semi")).select(*PHYSICAL, "title", "cwd")
    sources = ranked.select(*LOGICAL, F.explode("sources").alias("s")).select(*LOGICAL, F.col("s.first_id").alias("first_id"), F.col("s.source_path").alias("source_path"))
    named = sources.join(rolled, PHYSICAL).groupBy(*LOGICAL).agg(*[F.coalesce(F.min(F.when(F.col(c) != "", F.struct("first_id", c)))[c], F.lit("")).alias(c) for c in ("title", "cwd")])
    out = ranked.join(named, LOGICAL, "left").select(
        *LOGICAL, "matched_atoms", "match_count", format_timestamp(F.col("created")).alias("created"), format_timestamp(F.col("updated")).alias("updated"), "title", "cwd",
        F.array_join(F.transform("sources", lambda s: s["source_path"]), "|").alias("source_paths"), F.col("updated").alias("_updated"),
    )
    return out.orderBy(F.desc("matched_atoms"), F.desc("match_count"), F.desc_nulls_last("_updated"), "tool", "session_id").drop("_updated")


def search(messages: DataFrame, condition: Condition | None, *, limit: int = 20, **filters: object) -> DataFrame:
    """The best sessions: matched atoms, then matches, then newest. Titles are fetched for these only."""
    return _titled(_ranked(messages, condition, limit, filters), messages)


def search_enriched(messages: DataFrame, condition: Condition | None, *, limit: int = 20, **filters: object) -> DataFrame:
    """search() with message counts, snippets and last rounds of the sessions found; these are at most `limit` rows, and found once."""
    ranked = _ranked(messages, condition, limit, filters)
    # At most `limit` short rows come to the driver, so the search is not planned again for each thing that is fetched.
    ranked = messages.sparkSession.createDataFrame(ranked.collect(), ranked.schema)
    keys = F.broadcast(ranked.select(*LOGICAL))
    of_top = messages.join(keys, LOGICAL, "left_semi")
    counts = of_top.groupBy(*LOGICAL).agg(F.count("*").alias("message_count"))
    found, _ = matching_messages(of_top, condition, **filters)
    terms = positive_terms(condition) if condition is not None else []
    # The smallest ids of a session are kept as its rows come in; no session's ids are ever gathered.
    first = Window.partitionBy(*LOGICAL).orderBy("id")
    firsts = found.select(*LOGICAL, "id", "text").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SNIPPET_SOURCES)
    texts = firsts.select(*LOGICAL, "id", T.snippet(F.col("text"), terms, SNIPPET_CHARS).alias("s"))
    snippets = texts.groupBy(*LOGICAL).agg(F.array_sort(F.collect_list(F.struct("id", "s"))).alias("s"))
    snippets = snippets.select(*LOGICAL, F.array_join(F.slice(F.array_distinct(F.transform("s", lambda x: x["s"])), 1, SNIPPETS), "|").alias("snippets"))
    top = _titled(ranked, messages)
    return top.join(counts, LOGICAL, "left").join(snippets, LOGICAL, "left").join(last_rounds(of_top), LOGICAL, "left")
