"""Decisions in transcripts: sentences, which of them decide something, what was chosen and why, and what later messages add.

Everything up to the candidates is an expression over one sentence and costs no shuffle but the numbering of messages. Confirmations
are found by islands: a run of confirmations belongs to the decision that it follows without a gap of more than three messages.
Implementations meet decisions in a join on the words they share, so no transcript is folded row by row.

merged() brings candidates together that one message makes on the same choice, or that answer each other within two messages.

Other than by a fold, distances of implementations are counted from the decision's own message, and a confirming sentence that decides
something itself is a decision unless it confirms an earlier one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decision_patterns as P
from ..functions import regexes as R
from ..functions import text as T
from .windows import place

#: A sentence: code, link targets and other characters, up to a sentence end after which no consequence follows. Possessive throughout.
_ENDS = r"\n\r.!?。！？;；"
_GOES_ON = rf"[{_ENDS}](?={T.WHITE}*+(?:(?iu:so|therefore|thus){T.WHITE}*[,，]?{T.WHITE}+|(?:这样|因此|所以)))"
_CODE, _LINK = r"```(?s:.*?)(?:```|\z)|`[^`]*+(?:`|\z)", r"\]\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+(?:\)|\z)"
SENTENCE = rf"(?:[^`\]{_ENDS}]++|{_CODE}|{_LINK}|\]|{_GOES_ON})*+[{_ENDS}]?"

#: A sentence that matches the first pattern is left out unless it matches the second.
_GATES = [
    (P.FUTURE_PLAN, None), (P.DELIBERATION, None), (P.PROGRESS, None), (P.PROGRESS_NOISE, None), (P.CHOICE_LABEL, P.PREDICATE), (P.PROMPT, P.PREDICATE),
    (P.META, P.PREDICATE), (P.REFUSAL, P.PREDICATE), (P.NEGATIVE, P.REPLACEMENT), (P.STATUS, P.PREDICATE), (P.PLAN, P.PREDICATE),
]
_RAW_GATES = [P.NOISE_TAG, P.TABLE, P.HEADING, P.OPEN_QUESTION]


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, as an array; a lone heading is one."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), T.trim_white), lambda s: s != "")
    return F.when(T.matches(T.trim_white(text), P.HEADING), F.array(T.trim_white(text))).otherwise(parts)


def is_all_caps(text: Column) -> Column:
    """Whether a text reads as an instruction in capitals: 12 letters or more, 85 of 100 upper-case, and a mark or word of command."""
    letters, upper = (F.regexp_count(text, F.lit(p)) for p in (r"\p{L}", r"\p{Lu}"))
    return (letters >= 12) & (upper * 100 >= letters * 85) & (text.rlike(r"[:!\n]") | T.starts_with_any(text, ["DO ", "MUST "]))


def is_noise_message(text: Column) -> Column:
    """Whether a whole message is no part of the talk: injected texts, tool events and instructions to agents."""
    trimmed = F.regexp_replace(text, f"^{T.WHITE}+", "")
    noise = T.is_noise(text) | T.matches(text, P.NOISE_TAG) | T.matches(trimmed, P.LOOP_EVENT_NOISE)
    return noise | T.matches(trimmed, P.XML_NOISE) | T.matches(trimmed, P.AGENTS_NOISE) | is_all_caps(trimmed)


def segments(messages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence of user and assistant messages: `at` (place of the message in its transcript, from 1), `ordinal`, `segment`."""
    placed = place(messages, keys).where(F.lower("role").isin("user", "assistant") & ~is_noise_message(F.col("text")))
    return placed.select(*keys, "id", "at", F.lower("role").alias("role"), F.posexplode(sentences(F.col("text"))).alias("ordinal", "segment"))


def is_usable(role: Column, segment: Column, signal: Column) -> Column:
    ok = (F.length(segment) >= P.LEAST_SEGMENT) & (signal != "")
    for pattern in _RAW_GATES:
        ok = ok & ~T.matches(segment, pattern)
    for pattern, unless in _GATES:
        ok = ok & (~T.matches(signal, pattern) | (T.matches(signal, unless) if unless else F.lit(False)))
    ok = ok & (~T.matches(segment, P.BULLET) | T.matches(signal, P.EXPLICIT_CHOICE))
    return ok & ~((role == "assistant") & segment.startswith("{") & segment.endswith("}"))


def has_cue(signal: Column) -> Column:
    led = T.matches(signal, P.LEADING_USE) & T.matches(signal, P.CONSEQUENCE_AFTER)
    cue = T.matches(signal, P.STRONG_CUE) | (T.matches(signal, P.USAGE_CUE) & (T.matches(signal, P.SEMANTIC_USAGE) | led))
    states = signal.rlike("[.。!！;；,]|采用|选择") | F.lower(signal).contains("use ") | T.matches(signal, P.SEMANTIC_USAGE)
    return cue & (~T.matches(signal, P.QUESTION_WORDS) | states)


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, R.java(pattern), n)


def _upto(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.split(text, R.java(p), 2)[0]
    return text


def clean(value: Column, more: str = "") -> Column:
    edge = "[" + re.escape(P.CHOICE_EDGES) + "]+"
    out = T.collapse_white(F.regexp_replace(T.trim_white(value), f"^{edge}|{edge}\\z", ""))
    out = F.substring(out, 1, P.CHOICE_CHARS)
    return T.trim_white(F.regexp_replace(out, "[" + re.escape(P.CHOICE_EDGES + more) + "]+\\z", "")) if more else out


def choice(segment: Column) -> Column:
    """A struct of `options`, the chosen one first, and `chosen` (empty if none is named)."""
    concluded = T.matches(segment, P.CONSEQUENCE_BEFORE)
    clause = T.trim_white(_group(segment, P.CONSEQUENCE_BEFORE, 2))
    direct = concluded & T.matches(clause, P.CONSEQUENCE_CHOICE)
    text = F.when(concluded, clause).otherwise(segment)

    def named(chosen: Column, *others: Column) -> Column:
        return F.struct(F.array_distinct(F.filter(F.array(chosen, *others), lambda v: v != "")).alias("options"), chosen.alias("chosen"))

    def pair(a: Column, b: Column) -> tuple[Column, Column]:
        return (a != "") & (b != ""), named(a, b)

    concluding = clean(_upto(_group(clause, P.CONSEQUENCE_CHOICE, 1), P.CHOICE_REASON, P.REJECTED_TAIL), ".!?。！？")
    english = _group(text, P.INSTEAD, 1) != ""
    instead = pair(clean(F.when(english, _group(text, P.INSTEAD, 2)).otherwise(_group(text, P.INSTEAD, 4))), clean(F.when(english, _group(text, P.INSTEAD, 1)).otherwise(_group(text, P.INSTEAD, 3))))
    led = _group(text, P.COMPARISON, 1) != ""
    better = F.when(led, clean(_upto(T.trim_white(_group(text, P.COMPARISON, 1)), P.DESCRIPTOR_TAIL))).otherwise(clean(_group(text, P.COMPARISON, 3)))
    worse = F.when(led, clean(_upto(_group(text, P.COMPARISON, 2), P.TRAILING_CLAUSE))).otherwise(clean(_group(text, P.COMPARISON, 4)))
    compared = pair(better, worse)
    use, no_use = (F.regexp_instr(text, F.lit(R.java(p))) for p in (P.USE, P.NEGATIVE_USE))
    raw = _upto(_group(text, P.USE, 1), P.CHOICE_REASON, P.REJECTED_TAIL)
    pieces = F.split(raw, R.java(P.CHOICE_SEPARATOR))
    several = F.filter(F.transform(pieces, lambda v: clean(v)), lambda v: v != "")
    is_list = F.size(pieces).between(2, 5) & (F.size(several) > 1)
    used = F.when(is_list, F.struct(F.array_distinct(several).alias("options"), F.get(several, F.lit(0)).alias("chosen"))).otherwise(named(clean(raw)))
    return (
        F.when(direct, named(concluding))
        .when(T.matches(text, P.CHOOSE_OVER), named(clean(_group(text, P.CHOOSE_OVER, 1)), clean(_group(text, P.CHOOSE_OVER, 2))))
        .when(*instead).when(*compared)
        .when((use > 0) & ((no_use == 0) | (use < no_use)), used)
        .when(no_use == 0, named(clean(_upto(_group(text, P.LEADING_USE, 1), P.CHOICE_REASON, P.REJECTED_TAIL))))
        .otherwise(named(F.lit("")))
    )


def rationale(segment: Column) -> Column:
    """Why, as far as the sentence says so; else empty."""
    before = F.split(segment, R.java(P.CONSEQUENCE_AFTER), 2)[0]
    because = _group(segment, P.BECAUSE, 1)
    return (
        F.when(T.matches(segment, P.BECAUSE), clean(F.when(because != "", because).otherwise(_group(segment, P.BECAUSE, 2))))
        .when(T.matches(segment, P.PURPOSE), clean(_group(segment, P.PURPOSE, 1)))
        .when(T.matches(segment, P.CONSEQUENCE_BEFORE), clean(_group(segment, P.CONSEQUENCE_BEFORE, 1)))
        .when(T.matches(segment, P.CONSEQUENCE_AFTER) & (T.matches(before, P.EXPLICIT_CHOICE) | T.matches(before, P.LEADING_USE)), clean(_group(segment, P.CONSEQUENCE_AFTER, 1)))
        .otherwise("")
    )


def is_usable_chosen(chosen: Column, options: Column) -> Column:
    """Whether a choice names something: no pronoun, clause or general word, not too long, and one of the options if there are any."""
    name = clean(chosen)
    low = F.lower(name)
    general = T.matches(low, P.GENERIC_CHOICE) | T.matches(low, P.GENERIC_CHOICE_PREFIX) | T.starts_with_any(low, ["i ", "we "])
    clause = T.matches(name, P.CHOICE_CLAUSE) | T.matches(name, P.CHOICE_PRONOUN) | T.matches(name, P.TOOL_META_CHOICE)
    listed = (F.coalesce(F.size(options), F.lit(0)) < 1) | F.exists(options, lambda o: F.lower(clean(o)) == low)
    return (name != "") & ~general & ~clause & (F.length(name) <= P.USABLE_CHOICE_CHARS) & F.coalesce(listed, F.lit(False))


def reasons(signal: Column, options: Column, chosen: Column, why: Column, confirms: Column) -> Column:
    """What raised or lowered a candidate's confidence, in order."""
    strong, n = T.matches(signal, P.STRONG_CUE), F.size(options)
    replaced = F.lower(signal).contains("instead of") | F.lower(signal).contains("rather than") | signal.rlike("改用|而非|而不是")
    found = [
        F.when(T.matches(signal, P.USAGE_CUE) & ~strong & (why == ""), "descriptive-usage").otherwise("decision-word"),
        F.when(n > 1, "alternatives").when((n == 1) & strong, "chosen-option"),
        F.when(signal.rlike("[?？]"), "open-question"),
        F.when(chosen != "", "chosen-option").otherwise("missing-chosen-option"),
        F.when(why != "", "because-rationale"),
        F.when(replaced, "instead-of"),
        F.when(confirms, "explicit-confirmation"),
    ]
    return F.array_distinct(F.array_compact(F.array(*found)))


def confidence(signal: Column, options: Column, chosen: Column, why: Column, confirms: Column) -> Column:
    strong, n = T.matches(signal, P.STRONG_CUE), F.size(options)

    def step(condition: Column, gain: float, otherwise: float = 0.0) -> Column:
        return F.when(condition, gain).otherwise(otherwise)

    replaced = F.lower(signal).contains("instead of") | F.lower(signal).contains("rather than") | signal.rlike("改用|而非|而不是")
    total = F.lit(0.54) - step(T.matches(signal, P.USAGE_CUE) & ~strong & (why == ""), 0.04) + F.when(n > 1, 0.13).when((n == 1) & strong, 0.04).otherwise(0.0)
    total = total - step(signal.rlike("[?？]"), 0.08) + step(chosen != "", 0.08, -0.08) + step(why != "", 0.1) + step(replaced, 0.09) + step(confirms, 0.12)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def _character(n: Column) -> Column:
    surrogate = n.between(0xD800, 0xDFFF)
    return F.when(surrogate, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(surrogate, 0).otherwise(n)), 8, "0")), "UTF-32"))


def decision_id(session_id: Column, index: Column, ordinal: Column, segment: Column) -> Column:
    """Stable over runs; index counts messages from 0."""
    parts = F.concat_ws("\0", session_id, _character(index.cast("long")), _character(ordinal.cast("long")), segment)
    return F.concat(F.lit("decision-"), F.substring(F.sha2(parts, 256), 1, 16))


def _marked(messages: DataFrame, keys: list[str]) -> DataFrame:
    s = segments(messages, keys).withColumn("signal", T.strip_markdown(F.col("segment")))
    user, signal = F.col("role") == "user", F.col("signal")
    done = T.matches(signal, P.IMPLEMENT) | T.matches(signal, P.TEST) | T.matches(signal, P.TEST_FAIL)
    return s.withColumns({"confirms": user & T.matches(signal, P.CONFIRM), "implements": ~user & done, "cue": has_cue(signal) & is_usable(F.col("role"), F.col("segment"), signal)})


def candidates(messages: DataFrame, keys: list[str], *, least: float = P.ADMITTED_FROM, resolved_only: bool = False) -> DataFrame:
    """The sentences that decide something, with options, choice, rationale and confidence."""
    d = _marked(messages, keys).where("cue").withColumn("c", choice(F.col("segment"))).withColumn("rationale", rationale(F.col("segment")))
    facts = (F.col("signal"), F.col("c.options"), F.col("c.chosen"), F.col("rationale"), F.col("confirms"))
    d = d.withColumns({"confidence": confidence(*facts), "reasons": reasons(*facts)}).where(F.col("confidence") >= least)
    name = decision_id(F.col("session_id"), F.col("at") - 1, F.col("ordinal"), F.col("segment"))
    d = d.select(name.alias("decision_id"), *keys, "at", "ordinal", "role", "segment", "c.options", "c.chosen", "rationale", "confidence", "confirms", "reasons")
    return d.where((F.col("chosen") != "") & (F.col("rationale") != "") & is_usable_chosen(F.col("chosen"), F.col("options"))) if resolved_only else d


def confirmations(messages: DataFrame, decided: DataFrame, keys: list[str], within: int = P.CONFIRM_WITHIN) -> DataFrame:
    """The user's confirming sentences, each with the decision that it confirms."""
    yes = _marked(messages, keys).where("confirms").select(*keys, "at", "ordinal", F.col("segment").alias("quote"), F.lit(None).cast("string").alias("decision_id"))
    pure = decided.where("NOT confirms").select(*keys, "at", "ordinal", F.lit(None).cast("string").alias("quote"), "decision_id")
    both = decided.where("confirms").select(*keys, "at", "ordinal", F.col("decision_id").alias("own"))
    rows = yes.unionByName(pure).join(both, [*keys, "at", "ordinal"], "left")
    order = Window.partitionBy(*keys).orderBy("at", "ordinal")
    far = F.coalesce(F.col("at") - F.lag("at").over(order) > within, F.lit(True))
    rows = rows.withColumn("island", F.sum(F.when(F.col("decision_id").isNotNull() | far, 1).otherwise(0)).over(order))
    first = F.first(F.coalesce("decision_id", "own")).over(Window.partitionBy(*keys, "island").orderBy("at", "ordinal"))
    placed = rows.withColumn("confirmed", first).where("quote IS NOT NULL AND confirmed IS NOT NULL AND NOT (confirmed <=> own)")
    return placed.select(F.col("confirmed").alias("decision_id"), *keys, "at", "ordinal", "quote")


def tokens(text: Column) -> Column:
    """What a text is about: words, runs of CJK characters and paths, without generic ones."""
    plain = T.strip_markdown(text)
    words = F.filter(F.regexp_extract_all(F.lower(plain), F.lit(P.ASCII_TOKEN), F.lit(0)), lambda w: (F.length(w) >= P.LEAST_TOKEN) & ~w.isin(P.GENERIC_TOKENS))
    # A path is a run of path characters with a slash inside or a known ending; no nested repetition.
    runs = F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z0-9_./-]++"), F.lit(0)), lambda r: r.rlike(r"[^/]/[^/]|[^/]\.(?:go|py|js|ts|tsx|jsx|rs|java|sql|yaml|yml|json|md|toml|sh)\z"))
    return F.array_distinct(F.concat(words, F.regexp_extract_all(plain, F.lit(P.CJK_TOKEN), F.lit(0)), runs))


def related(decided: DataFrame, keys: list[str], within: int = P.RELATED_WITHIN) -> DataFrame:
    """Candidates (decision_id) with the latest one before them, at most `within` messages back, by the other role and on a shared token."""
    about = tokens(F.concat_ws(" ", "segment", "chosen", "rationale", F.array_join("options", " ")))
    d = decided.select(*keys, "at", "ordinal", F.lower("role").alias("role"), "decision_id", F.explode(about).alias("token"))
    earlier = d.select(*keys, F.col("at").alias("e_at"), F.col("ordinal").alias("e_ordinal"), F.col("role").alias("e_role"), F.col("decision_id").alias("earlier_id"), "token")
    met = d.join(earlier, [*keys, "token"]).where((F.col("e_at") < F.col("at")) & (F.col("at") - F.col("e_at") <= within) & (F.col("role") != F.col("e_role")))
    return met.groupBy("decision_id").agg(F.max_by("earlier_id", F.struct("e_at", "e_ordinal")).alias("earlier_id"))


def merged(decided: DataFrame, keys: list[str], within: int = P.RELATED_WITHIN) -> DataFrame:
    """Candidates brought together: those of one message with the same choice, then each with the related one before it.

    A merged row has the first context, choice and rationale that are not empty, all options, reasons and ids in order, the highest
    confidence and the last message. Chains of related candidates are followed by doubling, so long ones take few rounds.
    """
    place = F.struct("at", "ordinal", "decision_id")
    same = Window.partitionBy(*keys, "at", F.lower("chosen")).orderBy("ordinal", "decision_id")
    named = decided.withColumn("same_id", F.first("decision_id").over(same))
    firsts = named.where("decision_id = same_id")
    links = related(firsts, keys, within)
    up = firsts.select("decision_id").join(links, "decision_id", "left").select("decision_id", F.coalesce("earlier_id", "decision_id").alias("root"))
    while True:
        above = up.select(F.col("decision_id").alias("root"), F.col("root").alias("above"))
        next_up = up.join(above, "root").select("decision_id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        if decided.sparkSession.sparkContext.getCheckpointDir():
            next_up = next_up.checkpoint()
        moved = next_up.where("moved").isEmpty()
        up = next_up.select("decision_id", "root")
        if moved:
            break
    rows = named.join(up.select(F.col("decision_id").alias("same_id"), "root"), "same_id")

    def first_of(name: str) -> Column:
        return F.coalesce(F.min_by(F.when(F.col(name) != "", F.col(name)), F.when(F.col(name) != "", place)), F.lit("")).alias(name)

    def all_of(name: str) -> Column:
        lists = F.array_sort(F.collect_list(F.struct("at", "ordinal", "decision_id", F.col(name).alias("v"))))
        return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["v"]))).alias(name)

    ids = F.transform(F.array_sort(F.collect_list(place)), lambda p: p["decision_id"]).alias("members")
    return rows.groupBy(*keys, F.col("root").alias("decision_id")).agg(
        F.min("at").alias("message_start"), F.max("at").alias("message_end"), first_of("segment"), first_of("chosen"), first_of("rationale"),
        all_of("options"), all_of("reasons"), F.max("confidence").alias("confidence"), ids,
    )


def apply_judgments(decided: DataFrame, judgments: DataFrame, least: float = P.ADMITTED_FROM) -> DataFrame:
    """Candidates after judgments (decision_id, disposition, judged, reason_codes), `judged` being a confidence; those left below `least` go.

    suppress sets the confidence to 0; draft may only raise it, and only where choice and rationale are there; review leaves it. A
    candidate without a judgment stays as it is.
    """
    action = F.lower(F.trim("disposition"))
    complete = (F.col("chosen") != "") & (F.col("rationale") != "")
    told = F.transform(F.coalesce("reason_codes", F.array().cast("array<string>")), lambda r: F.concat(F.lit("llm:reason:"), F.trim(r)))
    note = F.when((action == "draft") & ~complete, "llm:review-missing-fields").when(action == "review", "llm:review")
    more = F.array_compact(F.concat(F.array(F.concat(F.lit("llm:"), action)), told, F.array(note)))
    judged = F.col("disposition").isNotNull()
    level = F.when(action == "suppress", 0.0).when((action == "draft") & complete, F.greatest("confidence", "judged")).otherwise(F.col("confidence"))
    out = decided.join(judgments, "decision_id", "left")
    out = out.withColumns({"reasons": F.when(judged, F.array_distinct(F.concat("reasons", more))).otherwise(F.col("reasons")), "confidence": F.coalesce(level, "confidence")})
    return out.where(F.col("confidence") >= least).drop("disposition", "judged", "reason_codes")


def implementations(messages: DataFrame, decided: DataFrame, keys: list[str], within: int = P.IMPLEMENT_WITHIN) -> DataFrame:
    """The assistant's sentences on what was done or tested, each with the latest decision before it that shares a token."""
    d = decided.select(*keys, F.col("at").alias("d_at"), F.col("ordinal").alias("d_ordinal"), "decision_id", F.explode(tokens(F.concat_ws(" ", "segment", "chosen", "rationale", F.array_join("options", " ")))).alias("token"))
    s = _marked(messages, keys).where("implements").select(*keys, "at", "ordinal", F.col("segment").alias("quote"), F.explode(tokens(F.col("segment"))).alias("token"))
    met = s.join(d, [*keys, "token"]).where(((F.col("d_at") < F.col("at")) | ((F.col("d_at") == F.col("at")) & (F.col("d_ordinal") < F.col("ordinal")))) & (F.col("at") - F.col("d_at") <= within))
    latest = met.groupBy(*keys, "at", "ordinal", "quote").agg(F.max_by("decision_id", F.struct("d_at", "d_ordinal")).alias("decision_id"))
    q = F.col("quote")
    test, failed = T.matches(q, P.TEST) | T.matches(q, P.TEST_FAIL), T.matches(q, P.TEST_FAIL)
    done = ~T.matches(q, P.NOT_DONE) & ((test & ~failed) | T.matches(q, P.IMPLEMENT))
    return latest.select("decision_id", *keys, "at", "ordinal", "quote", F.when(test, "test").otherwise("implementation").alias("kind"), F.when(done, "implemented").otherwise("unknown").alias("outcome"))


def _holding(quotes: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes (keys, quote) with the places (at) of messages of their session that hold a piece of them: they may hold the quote.

    The piece is what follows the quote's first white space, or where that is too short, what the quote begins with. Messages are cut
    into pieces at their white space; in sessions of quotes of the second kind, at each character.
    """
    piece = rf"(?s)(?=(.{{{P.LEAST_QUOTE}}}))"
    after_white = F.regexp_extract("quote", rf"(?s)\s(?=(.{{{P.LEAST_QUOTE}}}))", 1)
    asked = quotes.select(*keys, "quote", (after_white == "").alias("anywhere"), F.when(after_white == "", F.regexp_extract("quote", piece, 1)).otherwise(after_white).alias("piece"))

    def pieces(messages: DataFrame, pattern: str, anywhere: bool) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all("m_text", F.lit(pattern), 1))
        return messages.select(*keys, "at", F.lit(anywhere).alias("anywhere"), F.explode(found).alias("piece"))

    some, all_of = asked.where("NOT anywhere").select(*keys), asked.where("anywhere").select(*keys)
    at_words = pieces(said.join(some, keys, "left_semi"), rf"(?<=\s){piece}", False)
    at_all = pieces(said.join(all_of, keys, "left_semi"), piece, True)
    return asked.join(at_words.unionAll(at_all), [*keys, "anywhere", "piece"]).select(*keys, "quote", "at")


def check_evidence(evidence: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence (evidence_id, keys, kind, quote, at) with an outcome: ok, too_short, not_found or wrong_role.

    A quote must stand in a message as it is: in message number `at`, or in any where `at` is 0. Explicit evidence must be the user's.
    Quotes of the second kind look up the messages of their session that hold a piece of them, so only these are searched.
    """
    said = place(messages, keys).select(*keys, "at", F.lower(F.trim("role")).alias("m_role"), F.col("text").alias("m_text"))
    long_enough = F.length(T.trim_white(F.coalesce("quote", F.lit("")))) >= P.LEAST_QUOTE
    asked = evidence.where(long_enough)
    free = asked.where("coalesce(at, 0) <= 0")
    wanted = _holding(free.select(*keys, "quote").distinct(), said, keys)
    found_at = free.drop("at").join(wanted, [*keys, "quote"])
    spots = asked.where("at > 0").select("evidence_id", *keys, "quote", F.col("at").cast("long").alias("at"))
    spots = spots.unionByName(found_at.select("evidence_id", *keys, "quote", F.col("at").cast("long").alias("at")))
    hits = spots.join(said.withColumn("at", F.col("at").cast("long")), [*keys, "at"]).where(F.col("m_text").contains(F.col("quote")))
    found = hits.groupBy("evidence_id").agg(F.bool_or(F.coalesce(F.col("m_role") == "user", F.lit(False))).alias("by_user"))
    explicit = F.coalesce(F.lower(F.trim("kind")) == "explicit", F.lit(False))
    outcome = F.when(~long_enough, "too_short").when(F.col("by_user").isNull(), "not_found").when(explicit & ~F.col("by_user"), "wrong_role").otherwise("ok")
    return evidence.join(found, "evidence_id", "left").select("evidence_id", outcome.alias("outcome"))


def review_messages(decided: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages that decisions (decision_id, session_id, source_path, evidence) are reviewed against: decision_id, ts, id, role, text, origin.

    Those of the decision's session and, if it names one, of its source. For decisions of which there are none the quotes stored with
    them stand for messages (`origin` is evidence, ids count the quotes), said by the role they name or else by the user if they are
    explicit; decisions without either have no rows. Both are found in one pass over the messages.
    """
    d = decided.withColumns({"session_id": F.coalesce("session_id", F.lit("")), "source_path": F.trim(F.coalesce("source_path", F.lit("")))})
    asked = d.select("decision_id", F.col("session_id").alias("asked_session"), F.col("source_path").alias("asked_source"))
    here = messages.join(asked, (F.col("session_id") == F.col("asked_session")) & ((F.col("asked_source") == "") | (F.col("source_path") == F.col("asked_source"))))
    found = here.select("decision_id", "ts", F.col("id").cast("long").alias("id"), "role", "text", F.lit("session").alias("origin"))
    left = d.join(found.select("decision_id").distinct(), "decision_id", "left_anti").select("decision_id", F.posexplode("evidence").alias("place", "e"))
    role = F.lower(F.trim(F.coalesce("e.role", F.lit(""))))
    said = F.when(role.isin("user", "assistant"), role).when(F.lower(F.coalesce("e.kind", F.lit(""))) == "explicit", "user").otherwise("assistant")
    stored = left.where(T.trim_white(F.coalesce("e.quote", F.lit(""))) != "")
    return found.unionByName(stored.select("decision_id", F.lit(None).cast("double").alias("ts"), F.col("place").cast("long").alias("id"), said.alias("role"), F.col("e.quote").alias("text"), F.lit("evidence").alias("origin")))


def check_review(decided: DataFrame, messages: DataFrame) -> DataFrame:
    """Each decision with the origin of what it is reviewed against (none if there is nothing) and the outcomes of its evidence, in order.

    Outcomes are those of check_evidence(); evidence is an array of (kind, quote, role), checked anywhere in the messages.
    """
    reloaded = review_messages(decided, messages)
    origins = reloaded.groupBy("decision_id").agg(F.max("origin").alias("origin"), F.count("*").alias("n_messages"))
    each = decided.select("decision_id", F.posexplode("evidence").alias("place", "e")).select(F.struct("decision_id", "place").alias("evidence_id"), "decision_id", F.col("e.kind").alias("kind"), F.col("e.quote").alias("quote"), F.lit(0).alias("at"))
    checked = check_evidence(each, reloaded, ["decision_id"]).select(F.col("evidence_id.decision_id").alias("decision_id"), F.struct("evidence_id.place", "outcome").alias("o"))
    outcomes = checked.groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["outcome"]).alias("outcomes"))
    out = decided.select("decision_id").join(origins, "decision_id", "left").join(outcomes, "decision_id", "left")
    return out.select("decision_id", F.coalesce("origin", F.lit("none")).alias("origin"), F.coalesce("n_messages", F.lit(0).cast("long")).alias("n_messages"), F.coalesce("outcomes", F.array().cast("array<string>")).alias("outcomes"))


def context(messages: DataFrame, keys: list[str], radius: int = 2) -> DataFrame:
    """Each message with the ids of those around it, `radius` to either side."""
    around = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0.0)), "id").rowsBetween(-radius, radius)
    return messages.withColumn("context", F.collect_list("id").over(around))


# A candidate's state as a decision's, and back; what is not listed is proposed, or detected.
DECISION_STATES = {"approved": "accepted", "published": "accepted", "rejected": "rejected", "deferred": "deferred", "draft": "draft", "in_review": "draft"}
CANDIDATE_STATES = {"accepted": "approved", "rejected": "rejected", "deferred": "deferred", "draft": "draft"}


def decision_state(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DECISION_STATES.items() for x in kv]), status), F.lit("proposed"))


def candidate_state(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CANDIDATE_STATES.items() for x in kv]), status), F.lit("detected"))


# Decisions as rows: (status, outcome, kind, context, confidence, supersedes, options, evidence, session_id), evidence being an array of
# structs (kind, quote, message_index).

# What the fields may hold.
STATUSES = ["proposed", "accepted", "rejected", "deferred", "superseded", "draft"]
OUTCOMES = ["unknown", "planned", "implemented", "abandoned"]
IMPLEMENTATION_KINDS = ["implementation", "test", "tests_passed", "commit"]
EVIDENCE_KINDS = ["explicit", "transcript", "rationale", "alternative", *IMPLEMENTATION_KINDS]


def _kind(e: Column) -> Column:
    return F.lower(T.trim_white(F.coalesce(e["kind"], F.lit(""))))


def normalized(decided: DataFrame) -> DataFrame:
    """Decisions with defaults; implemented needs evidence of it, else the outcome is unknown."""
    blank = lambda c, default: F.when(T.trim_white(F.coalesce(c, F.lit(""))) == "", default).otherwise(F.col(c))
    proof = F.coalesce(F.exists("evidence", lambda e: _kind(e).isin(IMPLEMENTATION_KINDS)), F.lit(False))
    outcome = F.when((blank("outcome", "unknown") == "implemented") & ~proof, "unknown").otherwise(blank("outcome", "unknown"))
    return decided.withColumns({"kind": blank("kind", "decision"), "status": blank("status", "proposed"), "outcome": outcome, "options": F.coalesce("options", F.array().cast("array<string>"))})


def problem(decided: DataFrame) -> DataFrame:
    """The first thing that is wrong with each normalized decision, as `problem`; null if nothing is."""
    d = normalized(decided)
    blank = lambda c: T.trim_white(F.coalesce(c, F.lit(""))) == ""
    evidence = F.coalesce("evidence", F.array().cast(d.schema["evidence"].dataType))
    bad = lambda test: F.exists(evidence, test)
    level = F.col("confidence")
    wrong = (
        F.when(F.col("kind") != "decision", "kind").when(~F.col("status").isin(STATUSES), "status").when(blank("context"), "context").when(~F.col("outcome").isin(OUTCOMES), "outcome")
        .when(level.isNull() | F.isnan(level) | (level < 0) | (level > 1), "confidence").when((F.col("status") == "superseded") & blank("supersedes"), "supersedes")
        .when(F.exists("options", lambda o: T.trim_white(F.coalesce(o, F.lit(""))) == ""), "option").when(bad(lambda e: ~_kind(e).isin(EVIDENCE_KINDS)), "evidence kind")
        .when(bad(lambda e: F.length(T.trim_white(F.coalesce(e["quote"], F.lit("")))) < P.LEAST_QUOTE), "evidence quote").when(bad(lambda e: e["message_index"] < 0), "evidence index")
        .when(blank("session_id"), "session")
    )
    return d.withColumn("problem", wrong)


def list_decisions(current: DataFrame, supersessions: DataFrame, *, status: str = "", include_deleted: bool = False, limit: int = 0) -> DataFrame:
    """Candidates of kind decision as decisions, the last updated first. Deleted ones that were replaced are `superseded`; no other status tells."""
    rows = current.where("kind = 'decision'")
    gone = supersessions.where("kind = 'decision'").select(F.trim("candidate_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    if status == "superseded":
        rows = rows.where("status = 'deleted'")
    elif status:
        rows = rows.where(F.col("status") == candidate_state(F.lit(status)))
    elif not include_deleted:
        rows = rows.where("status <> 'deleted'")
    rows = rows.join(gone, "id", "left")
    state = F.when((F.col("status") == "deleted") & F.col("gone"), "superseded").otherwise(decision_state(F.col("status")))
    rows = rows.withColumn("state", state).drop("gone")
    rows = rows.where(F.col("state") == status) if status else rows
    rows = rows.orderBy(F.desc("updated_at"), "id")
    return rows.limit(limit) if limit > 0 else rows


def in_order(decided: DataFrame) -> DataFrame:
    return decided.orderBy("session_id", "at", "decision_id")
