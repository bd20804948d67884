"""Scalar text functions over columns; all are native expressions."""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regexes as R

# Prefixes of injected and of tool texts, and size limits.
NOISE_PREFIXES = ["<supermemory", "[SUPERMEMORY", "<system-reminder>", "<user_info>"]
TOOL_NOISE_PREFIXES = ["tool.call", "tool.result", "tool_use", "tool_result", "<tool", '{"type":"tool', '{"name":']
TITLE_CHARS, TEXT_BYTES, TRUNCATED = 120, 12288, "…[truncated]"
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WIDE = r"[\x{1100}-\x{115f}\x{2e80}-\x{303e}\x{3041}-\x{33ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a000}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}\x{1f300}-\x{1f64f}\x{1f900}-\x{1f9ff}]"


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(R.java(pattern)), F.lit(False))


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+\\z", "")


def collapse_white(text: Column) -> Column:
    return trim_white(F.regexp_replace(text, f"{WHITE}+", " "))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def ascii_lower_of(value: str) -> str:
    return value.translate(str.maketrans(_UPPER, _LOWER))


def relative_time(time: Column, now: Column) -> Column:
    """How long before or after `now`, both in seconds, a time is: just now, minutes, hours, days, months or years; - for null."""
    delta = F.abs(now - time)
    units = [(60, 3600, "m"), (3600, 86400, "h"), (86400, 30 * 86400, "d"), (30 * 86400, 365 * 86400, "mo"), (365 * 86400, None, "y")]
    value = F.when(delta < 60, "")
    for seconds, below, unit in units:
        count = F.concat(F.floor(delta / seconds).cast("string"), F.lit(unit))
        value = value.when(delta < below, count) if below else value.otherwise(count)
    return F.when(time.isNull(), "-").when(value == "", "just now").when(time > now, F.concat(F.lit("in "), value)).otherwise(F.concat(value, F.lit(" ago")))


def highlight(text: Column, terms: list[str], before: str, after: str) -> Column:
    """The text with every hit of a term between two marks, whatever the case; at a place, the longest term counts."""
    longest_first = sorted((t for t in terms if t), key=len, reverse=True)
    if not longest_first:
        return text
    pattern = "(?iu)(" + "|".join(re.escape(t) for t in longest_first) + ")"
    return F.regexp_replace(text, pattern, f"{_literal(before)}$1{_literal(after)}")


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def is_noise(text: Column) -> Column:
    return starts_with_any(F.regexp_replace(text, f"^{WHITE}+", ""), NOISE_PREFIXES)


def is_tool_noise(text: Column) -> Column:
    return starts_with_any(F.regexp_replace(text, f"^{WHITE}+", ""), TOOL_NOISE_PREFIXES)


def normalize_role(role: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.when(is_noise(text), "system").when(low.isin("user", "assistant"), low).otherwise("system")


def title_from_text(text: Column) -> Column:
    return F.substring(collapse_white(F.split_part(trim_white(text), F.lit("\n"), F.lit(1))), 1, TITLE_CHARS)


def truncate_bytes(text: Column, limit: int = TEXT_BYTES) -> Column:
    """At most `limit` bytes: longer texts are cut at a character boundary and marked."""
    room = limit - len(TRUNCATED.encode())
    raw = text.cast("binary")
    # The byte after the cut must not continue a character; one of four neighbouring cuts is free of that.
    cut = F.lit(room)
    for back in (3, 2, 1, 0):
        after = F.conv(F.hex(F.substring(raw, room - back + 1, 1)), 16, 10).cast("int")
        cut = F.when(after.bitwiseAND(F.lit(192)) != 128, room - back).otherwise(cut)
    return F.when(F.octet_length(text) > limit, F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit(TRUNCATED))).otherwise(text)


def clip(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("…"))).otherwise(text)


def message_summary(text: Column, chars: int = 240) -> Column:
    return clip(collapse_white(text), chars)


def display_width(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(WIDE)) - F.regexp_count(text, F.lit(r"[\p{Mn}\p{Me}]"))


def strip_ansi(text: Column) -> Column:
    out = F.regexp_replace(text, r"\x1B\[[0-?]*[ -/]*[@-~]|\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)|\x1B.", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\t\n\x0B\f\r]", " "), r"[\x00-\x1F\x7F]", "")


def plain_field(text: Column) -> Column:
    return collapse_white(strip_ansi(text))


def strip_markdown(text: Column) -> Column:
    for pattern in (R.FENCED_CODE, R.INLINE_CODE, R.MARKDOWN_LINK, R.MARKDOWN_MARKER):
        text = F.regexp_replace(text, R.java(pattern), " ")
    return trim_white(F.regexp_replace(text, r"\*\*|__|~~", " "))


def slugify(text: Column) -> Column:
    low = F.lower(trim_white(text))
    bare = F.regexp_replace(low, r"[\p{L}\p{Nd}&&[^a-z0-9]]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def short_id(value: Column) -> Column:
    return F.when(matches(value, f"^{R.UUID}$"), F.substring(value, 1, 8)).otherwise(F.substring(value, 1, 12))


def hinted(text: Column, hints: list[str]) -> Column:
    """Whether a text holds one of the hints, in the case folding of the patterns."""
    return text.rlike("(?iu)" + "|".join(re.escape(h) for h in hints))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def redact(text: Column) -> Column:
    """Replaces secrets and personal data, pattern after pattern; patterns of whose hints a text has none are passed over."""

    def step(k: int, out: Column, folded: Column) -> Column:
        if k == len(R.REDACTIONS):
            return out
        (pattern, replacement), hints = R.REDACTIONS[k], R.REDACTION_HINTS[k]
        some = reduce(operator.or_, [folded.contains(h.lower()) for h in hints])
        replaced = lambda x: F.when(some, F.regexp_replace(x, R.java(pattern), replacement.replace("\\1", "$1"))).otherwise(x)
        return let(out, lambda x: step(k + 1, replaced(x), folded))

    # The one letter beyond lower case that the patterns take for an ASCII one is U+017F.
    return let(F.translate(F.lower(text), "ſ", "s"), lambda folded: step(0, text, folded))


def secret_count(text: Column) -> Column:
    total = F.lit(0)
    for pattern, hints in zip(R.SECRETS, R.SECRET_HINTS, strict=True):
        count = F.coalesce(F.regexp_count(text, F.lit(R.java(pattern))), F.lit(0))
        total = total + F.when(hinted(text, hints), count).otherwise(0)
    return total.cast("long")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and their base letters."""
    marked = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    marked = [(c, d[0]) for c, d in marked if len(d) > 1 and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in marked), "".join(b for _, b in marked)


def token_text(text: Column) -> Column:
    """Lower case without accents, words separated and enclosed by single spaces: a phrase is found by its own token text."""
    marked, bare = _accents()
    folded = F.regexp_replace(F.translate(F.lower(text), marked, bare), r"\p{Mn}", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))


def token_text_of(value: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", value.lower()) if unicodedata.category(c) != "Mn")
    return " " + " ".join("".join(c if c.isalnum() else " " for c in plain).split()) + " "


def snippet(text: Column, terms: str | list[str], chars: int = 200) -> Column:
    """The collapsed text around the earliest hit of any term, of `chars` characters, an ellipsis for each side that is cut."""
    flat = collapse_white(text)
    places = [F.locate(t.lower(), F.lower(flat)) for t in ([terms] if isinstance(terms, str) else terms) if t]
    found = [F.when(p > 0, p) for p in places]
    hit = F.coalesce(F.least(*found, F.lit(None).cast("int")) if found else F.lit(0), F.lit(0)) - 1
    start = F.greatest(F.lit(0), F.least(hit - chars // 3, F.length(flat) - chars))
    window = F.substring(flat, start + 1, F.lit(chars))
    window = F.when(start > 0, F.concat(F.lit("…"), F.substring(window, F.lit(2), F.lit(chars)))).otherwise(window)
    window = F.when(start + chars < F.length(flat), F.concat(F.substring(window, F.lit(1), F.lit(chars - 1)), F.lit("…"))).otherwise(window)
    return F.when(F.length(flat) <= chars, flat).when(hit < 0, F.concat(F.substring(flat, 1, chars - 1), F.lit("…"))).otherwise(window)
