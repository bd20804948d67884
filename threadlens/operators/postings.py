"""Postings: which sessions hold which three characters, looked up before any text is read.

A row has a gram, a part of the sessions and the keys of the part's sessions that hold the gram; parts are so many that a row has some
SESSIONS keys at most. The table is a plain one, versioned by parts as streaming/refresh.py does it and sorted by gram, so a
lookup reads of each part the pages with the grams asked for, and a change of sessions writes their parts anew.

A search asks for the sessions that hold all grams of a text (of its lower case or of its folded words), put together as the
condition says. That is more than match, never less: the search itself then runs over the texts of these sessions alone and finds what it
would find in all. Where a condition says nothing about what a session must hold (below Not, or texts of one or two characters), all
sessions are searched.

Defined results: null texts hold nothing; messages with a null tool or session are found as any; repeated messages change nothing; other
columns are ignored; an empty table gives empty postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.refresh import read_table, rebuild, write_version
from .search import Condition, Not, Or, Phrase, Term, search, words_of
from .sessions import LOGICAL

SIZE, SESSIONS = 3, 8192


def session_key() -> Column:
    return F.xxhash64(*LOGICAL)


def grams(text: Column) -> Column:
    """All runs of three characters of the lower-cased text and of its folded words."""
    every = lambda t: F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1))
    return F.array_distinct(F.concat(every(F.lower(text)), every(T.token_text(text))))


def _grams_of(value: str) -> list[str]:
    return list(dict.fromkeys(value[i : i + SIZE] for i in range(len(value) - SIZE + 1)))


def postings(messages: DataFrame, parts: int) -> DataFrame:
    """gram, part and keys of the sessions; each session's grams are made distinct before they are gathered."""
    each = messages.where(F.col("text").isNotNull()).select(session_key().alias("key"), F.explode(grams(F.col("text"))).alias("gram")).distinct()
    return each.groupBy("gram", F.pmod("key", F.lit(parts)).cast("int").alias("part")).agg(F.array_sort(F.collect_list("key")).alias("keys"))


def build(messages: DataFrame, target: str, *, sessions: int = SESSIONS) -> int:
    """Write the postings of all messages to `target`; the number of parts, which later changes keep."""
    n = messages.select(session_key().alias("key")).distinct().count()
    parts = max(1, -(-n // sessions))
    rebuild(postings(messages, parts), target, key="part", order=["gram"])
    return parts


def update(messages: DataFrame, changed: DataFrame, target: str, number: int, *, parts: int) -> None:
    """Version `number` of the postings, after sessions (tool, session_id) came, changed or went; `messages` are those of now."""
    part = F.pmod(session_key(), F.lit(parts)).cast("int").alias("part")
    touched = [r.part for r in changed.select(part).distinct().collect()]  # at most as many as there are parts
    gone = messages.sparkSession.createDataFrame([(p,) for p in touched], "part int")
    write_version(messages.sparkSession, target, number, postings(messages.where(part.isin(touched)), parts), gone=gone, key="part", order=["gram"])


def _needs(c: Condition) -> tuple | None:
    """What a session must hold for a message of it to match: ("gram", g), ("and", ...) or ("or", ...); None if that can't be said."""
    if isinstance(c, Not):
        return None
    if isinstance(c, (Term, Phrase)):
        words = words_of(c.value)
        if isinstance(c, Term) and words and any(not ch.isalnum() and ch != "_" for ch in c.value):
            return _join("and", [_holds(w) for w in words])
        return _holds(c.value)
    sides = [_needs(c.left), _needs(c.right)]
    return _join("or" if isinstance(c, Or) else "and", sides)


def _holds(value: str) -> tuple | None:
    if len(value) < SIZE:
        return None
    ways = [("and", *[("gram", g) for g in _grams_of(value.lower())])]
    folded = T.token_text_of(value)
    if folded.strip():
        ways.append(("and", *[("gram", g) for g in _grams_of(folded)]))
    return ("or", *ways)


def _join(how: str, sides: list[tuple | None]) -> tuple | None:
    known = [s for s in sides if s is not None]
    if how == "or" and len(known) < len(sides) or not known:
        return None
    return (how, *known)


def candidate_sessions(table: DataFrame, condition: Condition | None) -> DataFrame | None:
    """The keys of the sessions that may match, from postings; None if all may."""
    needs = None if condition is None else _needs(condition)
    if needs is None:
        return None
    asked: dict[str, str] = {}

    def flag(need: tuple) -> Column:
        if need[0] == "gram":
            return F.col(asked.setdefault(need[1], f"g{len(asked)}"))
        out = flag(need[1])
        for more in need[2:]:
            out = out & flag(more) if need[0] == "and" else out | flag(more)
        return out

    wanted = flag(needs)
    found = table.where(F.col("gram").isin(list(asked))).select("gram", F.explode("keys").alias("key"))
    return found.groupBy("key").agg(*[F.bool_or(F.col("gram") == g).alias(name) for g, name in asked.items()]).where(wanted).select("key")


def narrowed(messages: DataFrame, table: DataFrame, condition: Condition | None) -> DataFrame:
    """The messages of the sessions that may match."""
    keys = candidate_sessions(table, condition)
    return messages if keys is None else messages.join(keys, session_key() == keys["key"], "left_semi")


def indexed_search(spark: SparkSession, messages: DataFrame, target: str, condition: Condition | None, **options: object) -> DataFrame:
    """search() by the postings at `target`."""
    table = read_table(spark, target)
    return search(messages if table is None else narrowed(messages, table, condition), condition, **options)
