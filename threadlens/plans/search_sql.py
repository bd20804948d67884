"""Search conditions as DuckDB SQL, for comparison."""

from __future__ import annotations

from ..functions.text import token_text_of
from ..operators.search import And, Condition, Near, Not, Or, Phrase, Term, has_not, is_han, positive_atoms, words_of
from .tables import MESSAGES_SQL


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def has_sql(value: str) -> str:
    parts = []
    if (tokens := token_text_of(value)).strip():
        parts.append(f"contains(tok, {quoted(tokens)})")
    if len(value) >= 3 or is_han(value) or len(value) < 3:
        parts.append(f"contains(lower(text), {quoted(value.lower())})")
    return "coalesce(" + " OR ".join(parts) + ", false)"


def condition_sql(c: Condition) -> str:
    over = "OVER (PARTITION BY tool, session_id)"
    if isinstance(c, Term) and any(not ch.isalnum() and ch != "_" for ch in c.value) and words_of(c.value):
        each = [has_sql(w) for w in words_of(c.value)]
        return "(" + " AND ".join(f"bool_or({e}) {over}" for e in each) + " AND (" + " OR ".join(each) + "))"
    if isinstance(c, (Term, Phrase)):
        return has_sql(c.value)
    if isinstance(c, Not):
        return f"(NOT {condition_sql(c.of)})"
    left, right = condition_sql(c.left), condition_sql(c.right)
    if isinstance(c, Or):
        return f"({left} OR {right})"
    if isinstance(c, And) or has_not(c):
        return f"({left} AND {right})"
    assert isinstance(c, Near)
    return f"(({left} OR {right}) AND bool_or({left}) {over} AND bool_or({right}) {over})"


TOKENS_SQL = r"' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}\p{Co}]+', ' ', 'g')) || ' '"
ROLLUP_SQL = r"""roll AS (
  SELECT tool, session_id, source_path, min(ts) AS created, max(ts) AS updated, coalesce(arg_min(cwd, id) FILTER (cwd <> ''), '') AS cwd,
    coalesce(arg_min(title, id) FILTER (role = 'user' AND title <> ''), '') AS title, count(*) AS n_messages
  FROM (SELECT *, substr(trim(regexp_replace(split_part(trim(text, E' \n\t\r'), E'\n', 1), '\s+', ' ', 'g')), 1, 120) AS title FROM m)
  GROUP BY ALL)"""
TIME_SQL = "strftime(make_timestamp((floor({0})::BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def search_sql(c: Condition | None, *, tools: list[str] = (), cwds: list[str] = (), after: float | None = None, include_system: bool = False, limit: int = 20) -> str:
    where = [] if include_system else ["role IN ('user', 'assistant')"]
    where += [f"tool = {quoted(t)}" for t in tools] + [f"contains(lower(cwd), {quoted(w.lower())})" for w in cwds] + ([f"ts >= {after}"] if after is not None else [])
    atoms = positive_atoms(c) if c else []
    flags = "".join(f", {condition_sql(a)} AS a{i}" for i, a in enumerate(atoms))
    matched = " + ".join(f"max(a{i}::INT)" for i in range(len(atoms))) or "0"
    return f"""
WITH {MESSAGES_SQL}, {ROLLUP_SQL},
u AS (SELECT *, {TOKENS_SQL} AS tok FROM m WHERE {' AND '.join(where) or 'true'}),
f AS (SELECT *, {condition_sql(c) if c else 'true'} AS hit{flags} FROM u),
p AS (SELECT tool, session_id, source_path, count(*) AS n, min(id) AS first_id{''.join(f', bool_or(a{i}) AS a{i}' for i in range(len(atoms)))} FROM f WHERE hit GROUP BY ALL)
SELECT tool, session_id, ({matched})::INT AS matched_atoms, sum(n)::BIGINT AS match_count, {TIME_SQL.format('min(created)')} AS created, {TIME_SQL.format('max(updated)')} AS updated,
  coalesce(arg_min(title, first_id) FILTER (title <> ''), '') AS title, coalesce(arg_min(cwd, first_id) FILTER (cwd <> ''), '') AS cwd, string_agg(source_path, '|' ORDER BY first_id) AS source_paths
FROM p JOIN roll USING (tool, session_id, source_path) GROUP BY tool, session_id
ORDER BY matched_atoms DESC, match_count DESC, max(roll.updated) DESC NULLS LAST, tool, session_id LIMIT {limit}
"""
