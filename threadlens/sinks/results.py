"""Results as JSON lines, for callers: fields in a fixed order, texts as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_line(fields: dict[str, Column], omit_empty: list[str] = ()) -> Column:
    """One row as a JSON object of these fields in their order; null texts are empty, and those in `omit_empty` are left out if empty."""
    text = lambda name, c: F.nullif(F.coalesce(c, F.lit("")), F.lit("")) if name in omit_empty else c
    return F.to_json(F.struct(*[text(name, c).alias(name) for name, c in fields.items()]), {"ignoreNullFields": "true"})


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows with one text column, a line each, written by the tasks that hold them; an ordered frame keeps its order over the files' names."""
    rows.write.text(path)
