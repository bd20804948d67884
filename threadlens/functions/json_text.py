"""JSON texts with a fixed order of fields, keys sorted and <, > and & escaped, so that equal values have equal digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, redact

#: A string in a JSON text, quotes included. Possessive, so that the length of a string costs no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMBER = r"-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"

# What is escaped beyond the rules of JSON.
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def escape_html(json: Column) -> Column:
    for raw, escaped in ESCAPED.items():
        json = F.replace(json, F.lit(raw), F.lit(escaped))
    return json


def json_string(value: Column, html: bool = True) -> Column:
    whole = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    literal = F.substring(whole, F.lit(6), F.length(whole) - 6)
    return escape_html(literal) if html else literal


def json_strings(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: json_string(v)), ","), F.lit("]"))


def json_number(value: Column) -> Column:
    """Whole numbers without a point, small ones without an exponent."""
    small = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"0+\z", "")
    return F.when(value == F.floor(value), value.cast("long").cast("string")).when(F.abs(value) < 1e-3, small).otherwise(value.cast("string"))


def json_object(fields: dict[str, Column]) -> Column:
    """An object of the fields in their order; the values are JSON already."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def parse_json(text: Column) -> Column:
    """The value of a JSON text, null for what is none. Spark's own function overlooks what follows the first value.

    With more than one value in it a text can't be both the one element of a list and the one value of an object.
    """
    alone = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.when(alone[0] & alone[1], F.try_parse_json(text))


def _woven(gaps: Column, between: Column) -> Column:
    """gap, between, gap, ..., gap as one text."""
    return F.array_join(F.zip_with(gaps, between, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")


def map_strings(json: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON text with change(value) for the value of every string and key in it, however deep; what does not change stays as it is written."""

    def one(literal: Column) -> Column:
        value = F.try_variant_get(F.try_parse_json(literal), "$", "string")
        return let(value, lambda v: let(change(v), lambda after: F.when(after == v, literal).otherwise(json_string(after))))

    return _woven(F.split(json, STRING, -1), F.transform(F.regexp_extract_all(json, F.lit(STRING), F.lit(0)), one))


def plain_number(number: Column) -> Column:
    """A JSON number as the nearest double in its shortest digits: no exponent from 1e-6 to below 1e21, else one without zeros before it; zero has no sign."""
    def write(x: Column) -> Column:
        shortest = x.cast("string")
        size = F.abs(x)
        point = F.when(size >= 1, shortest.try_cast("decimal(38,16)").cast("string")).otherwise(shortest.try_cast("decimal(38,30)").cast("string"))
        digits = F.regexp_replace(F.regexp_replace(point, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
        exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(shortest, r"\.0E", "E"), r"E([0-9])", "e+$1"), "E-", "e-")
        exponent = F.regexp_replace(exponent, r"e([+-])([0-9])\z", "e$10$2")
        exponent = F.regexp_replace(exponent, r"e-0([0-9])\z", "e-$1")
        return F.when(size == 0, "0").when((size < 1e-6) | (size >= 1e21), exponent).otherwise(digits)

    return let(number.try_cast("double"), write)


def map_numbers(json: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON text with change(number) for every number outside its strings."""
    numbers = lambda gap: _woven(F.split(gap, NUMBER, -1), F.transform(F.regexp_extract_all(gap, F.lit(NUMBER), F.lit(0)), change))
    strings = F.regexp_extract_all(json, F.lit(STRING), F.lit(0))
    return _woven(F.transform(F.split(json, STRING, -1), numbers), strings)


def redact_json(text: Column) -> Column:
    """A JSON text whose strings and keys are redacted one by one, at any depth; it is rewritten with sorted keys if that changed any.

    What is no JSON is redacted as plain text. Keys that are equal once redacted stay as they are, in their old order.
    """
    changed = let(map_strings(text, redact), lambda after: F.when(after == text, text).otherwise(F.coalesce(canonical_json(after), after)))
    return F.when(parse_json(text).isNull(), redact(text)).otherwise(changed)


def canonical_json(text: Column) -> Column:
    """The same value with sorted keys and no spaces; {} for an empty text, null for what is no JSON."""
    sorted_keys = F.to_json(parse_json(text))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("{}")).otherwise(escape_html(map_numbers(sorted_keys, plain_number)))
