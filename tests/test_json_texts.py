"""JSON texts of any depth: message contents, redaction, canonical numbers."""

import json
import random

from pyspark.sql import functions as F

from threadlens.functions import json_text
from threadlens.functions import text as T
from threadlens.sources.jsonl import content_text


def extracted(v):
    """The text of a content, by plain recursion."""
    if isinstance(v, dict):
        return v["text"] if isinstance(v.get("text"), str) else extracted(v.get("content"))
    if isinstance(v, list):
        found = [extracted(x) for x in v if isinstance(x, str | dict)]
        return "\n".join(x for x in found if x)
    return v if isinstance(v, str) else ""


def content(g, depth):
    kind = g.random()
    if depth == 0 or kind < 0.2:
        return g.choice(["x", "", "a\nb", 1, None, True, 2.5])
    if kind < 0.55:
        return [content(g, depth - 1) for _ in range(g.randint(0, 3))]
    return ({"text": g.choice(["t", "", 5, None, ["q"]])} if g.random() < 0.3 else {}) | ({"content": content(g, depth - 1)} if g.random() < 0.8 else {})


def test_content_of_any_depth(spark):
    g = random.Random(3)
    deep = "end"
    for k in range(300):
        deep = [{"content": deep}, "s"] if k % 2 else {"content": deep}
    values = [{"content": [{"text": "x"}]}, [{"content": [{"content": [{"text": "deep"}]}]}], deep, *(content(g, g.randint(0, 9)) for _ in range(300))]
    rows = spark.createDataFrame([(i, json.dumps({"c": v})) for i, v in enumerate(values)], "i int, raw string").select("i", F.try_parse_json("raw").alias("v"))
    got = {r.i: r.t for r in rows.select("i", content_text("c").alias("t")).collect()}
    assert got == {i: extracted(v) for i, v in enumerate(values)}


def test_redaction_of_json(spark):
    long = "a\n" * 200_000
    cases = {
        '{"b": 1e3, "a": [{"me@x.com": "token = abc", "n": [[["/home/u/x", 2.50]]]}]}': '{"a":[{"[REDACTED_EMAIL]":"[REDACTED_SECRET]","n":[[["[REDACTED_PATH]",2.5]]]}],"b":1000}',
        '{"k": 5.0, "a": "b"}': '{"k": 5.0, "a": "b"}',  # unchanged texts stay as written
        "no JSON me@x.com": "no JSON [REDACTED_EMAIL]",
        '{"p":"q\\n\\"me@x.com\\" <"}': '{"p":"q\\n\\"[REDACTED_EMAIL]\\" \\u003c"}',
        json.dumps({"x": long + "me@x.com"}): json.dumps({"x": long + "[REDACTED_EMAIL]"}, separators=(",", ":")),
        '{"me@x.com":1,"you@x.com":2}': '{"[REDACTED_EMAIL]":1,"[REDACTED_EMAIL]":2}',
        "": "", "[]": "[]", '"secret: x"': '"[REDACTED_SECRET]"',
    }
    rows = spark.createDataFrame([(c,) for c in cases] + [(None,)], "j string")
    got = {r.j: r.r for r in rows.select("j", json_text.redact_json(F.col("j")).alias("r")).collect()}
    assert got == cases | {None: None}


def test_what_follows_a_value_is_no_json(spark):
    """A text is JSON if all of it is one value."""
    more = ['12 "token = abc" me@x.com', '{"a":"me@x.com"} password: "x"', '"me@x.com" token = "a b"', '["a"] token="x y"', '1, "b": 2', "1, 2", "1] 2", "1} 2", '{"a":1}{"b":2}', "1, ", " "]
    whole = ['{"a":"x"} ', " 12\n", "null", '"a"', "[1, 2]", "true"]
    rows = spark.createDataFrame([(c,) for c in more + whole], "j string")
    got = rows.select("j", json_text.redact_json(F.col("j")).alias("r"), T.redact(F.col("j")).alias("plain"), json_text.canonical_json(F.col("j")).alias("c")).collect()
    assert [r.j for r in got if r.c is not None] == whole
    assert all(r.r == r.plain for r in got) and "token = abc" not in got[0].r


def test_numbers(spark):
    cases = {
        "1e3": "1000", "1.50": "1.5", "0": "0", "12345678901234567890123": "1.2345678901234568e+22", "1e21": "1e+21", "1e20": "100000000000000000000", "123456.789": "123456.789",
        "1e-7": "1e-7", "0.000001": "0.000001", "1.5e-7": "1.5e-7", "1.7976931348623157e308": "1.7976931348623157e+308", "-2.5e-10": "-2.5e-10", "100": "100", "9007199254740993": "9007199254740992",
    }
    rows = spark.createDataFrame([(c, f'{{"b":"1e3","a":[{c}]}}') for c in cases], "n string, j string")
    got = {r.n: r.c for r in rows.select("n", json_text.canonical_json(F.col("j")).alias("c")).collect()}
    assert got == {n: f'{{"a":[{want}],"b":"1e3"}}' for n, want in cases.items()}
