"""Skill bundles from sessions, with slugs that avoid each other, and their text form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions import text as T
from .incremental import pending_sessions
from .sessions import session_rollup
from .signals import quality_gate, signal_bundle
from .windows import instructions

# Sizes, and sentences of a bundle.
SLUG_CHARS, LEAST_SLUG, TRIGGER_CHARS, HIGH_RISK = 64, 3, 180, 0.8
NO_TRIGGER = "Use when the validated workflow from this session is requested."


def trigger(first_user: Column, intent: Column) -> Column:
    text = F.regexp_replace(T.message_summary(F.coalesce(first_user, F.lit("")), TRIGGER_CHARS), r"\.\z", "")
    known = F.concat(F.lit("Use when the user requests a "), intent, F.lit(" workflow."))
    return F.when(text != "", F.concat(F.lit("Use when the user asks to "), text, F.lit("."))).when((intent == "") | (intent == "unknown"), NO_TRIGGER).otherwise(known)


def risks(evidence: Column, one_off: Column, secret: Column, intent: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(evidence == "", "insufficient success evidence"),
            F.when(one_off >= HIGH_RISK, F.format_string("one-off risk %.2f", one_off)),
            F.when(secret > 0, F.format_string("secret risk %.2f", secret)),
            F.when(intent == "correction", "correction or retry pattern"),
        )
    )


def cut_slug(slug: Column, chars: Column | int = SLUG_CHARS) -> Column:
    return F.when(F.length(slug) > chars, F.regexp_replace(F.substring(slug, F.lit(1), F.lit(chars) if isinstance(chars, int) else chars), "^-+|-+\\z", "")).otherwise(slug)


def clean_messages(messages: DataFrame) -> DataFrame:
    """User and assistant messages with text, roles in lower case, without injected texts."""
    role, text = F.lower(T.trim_white(F.col("role"))), T.trim_white(F.col("text"))
    return messages.withColumn("role", role).where(F.col("role").isin("user", "assistant") & (text != "") & ~T.matches(text, R.INJECTED_NOISE))


def evidence(messages: DataFrame, keys: list[str]) -> DataFrame:
    """What speaks for a session's success: users' acceptance and passed tests, numbered in order.

    keys, evidence_id, kind, message_index (from 0, among the clean messages), role, source_path and summary.
    """
    m = clean_messages(messages)
    order = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0.0)), "id")
    m = m.withColumn("message_index", F.row_number().over(order) - 1)
    text = T.trim_white(F.col("text"))
    kinds = F.array_compact(F.array(F.when((F.col("role") == "user") & T.matches(text, R.ACCEPTANCE), "acceptance"), F.when(T.matches(text, R.TEST_PASSED), "tests_passed")))
    each = m.select(*keys, "message_index", "role", "source_path", T.message_summary(F.col("text")).alias("summary"), F.posexplode(kinds).alias("nth", "kind"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("message_index", "nth"))
    return each.select(*keys, F.concat(F.lit("evidence-"), number).alias("evidence_id"), "kind", "message_index", "role", "source_path", "summary")


def evidence_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.orderBy(*keys, "message_index", "evidence_id")


def evidence_kinds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The kinds of a session's evidence, each once, as they first occur."""
    firsts = rows.groupBy(*keys, "kind").agg(F.min(F.struct("message_index", "evidence_id")).alias("first"))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]), "|").alias("kinds"))


def repaired_turns(turns: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """A decision, new or same, for each of a session's n user turns (keys, n), from those told (keys, turn, decision).

    Turn 0 is always new; a turn that nothing is told of is the same task, and `missing`.
    """
    every = counts.where("n > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("turn"))
    told = turns.where("coalesce(decision, '') <> ''").groupBy(*keys, F.col("turn").cast("long").alias("turn")).agg(F.max("decision").alias("decision"))
    missing = F.col("decision").isNull()
    return every.join(told, [*keys, "turn"], "left").select(*keys, "turn", F.when(F.col("turn") == 0, "new").otherwise(F.coalesce("decision", F.lit("same"))).alias("decision"), missing.alias("missing"))


def segments(messages: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Clean messages with the number of their task: a task starts at a user turn that is new; what comes before the first turn is dropped.

    Without any turn of its own, a session is one task.
    """
    m = clean_messages(messages)
    order = Window.partitionBy(*keys).orderBy(F.coalesce("ts", F.lit(0.0)), "id")
    text = T.trim_white(F.col("text"))
    asks = (F.col("role") == "user") & ~(text.contains("/resume-claude") | text.contains("<skill_information") | text.startswith("I executed a terminal command:"))
    m = m.withColumn("asks", asks).withColumn("turn", F.sum(F.col("asks").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    told = turns.select(*keys, F.col("turn").alias("t"), "decision").withColumnRenamed("t", "turn")
    m = m.join(told, [*keys, "turn"], "left")
    starts = F.col("asks") & ((F.col("turn") == 0) | (F.col("decision") == "new").eqNullSafe(F.lit(True)))
    m = m.withColumn("segment", F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.max("turn").over(Window.partitionBy(*keys)) < 0
    return m.withColumn("whole", whole).where("whole OR segment >= 1").withColumn("segment", F.when(F.col("whole"), 1).otherwise(F.col("segment"))).drop("asks", "turn", "decision", "whole")


def apply_judgments(bundle: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Bundles after judgments (keys, verdict, judged, judged_one_off, judged_secret, reason_codes); risks are only ever raised.

    suppress drops a bundle; review keeps it as a draft to look at; draft may raise its confidence and score, where slug, trigger and
    instructions are there. Whatever else was said, high risks or no evidence suppress it, but for review. Bundles without one stay.
    """
    b = bundle.join(judgments, keys, "left")
    c, judged, verdict = F.col, F.col("verdict").isNotNull(), F.col("verdict")
    complete = (c("slug") != "") & (c("trigger") != "") & (c("instructions") != "")
    raised = (verdict == "draft") & complete & (c("judged") > c("confidence")) & (c("disposition") != "suppress")
    note = F.when(verdict == "review", "llm:review").when((verdict == "draft") & ~complete, "llm:review-missing-fields")
    told = F.transform(F.coalesce("reason_codes", F.array().cast("array<string>")), lambda r: F.concat(F.lit("llm:"), F.trim(r)))
    more = F.array_distinct(F.filter(F.concat(F.split("reasons", "\\|"), told, F.array_compact(F.array(note))), lambda r: r != ""))
    one_off, secret = F.greatest("one_off_risk", "judged_one_off"), F.greatest("secret_risk", "judged_secret")
    hard = (verdict != "review") & ((one_off >= 0.8) | (secret >= 0.75) | (c("success_evidence") == ""))
    out = F.when((verdict == "suppress") | hard, "suppress").when((verdict == "review") | ((verdict == "draft") & ~complete), "draft").otherwise(c("disposition"))
    action = F.when((verdict == "suppress") | hard, "suppress").when((verdict == "review") | ((verdict == "draft") & ~complete), "review").otherwise("draft")
    score = F.when((verdict == "suppress") | hard, 0.0).when(raised, F.greatest("score", "judged")).otherwise(c("score"))
    new = {
        "disposition": out, "score": score, "confidence": F.when(raised, c("judged")).otherwise(c("confidence")), "one_off_risk": one_off, "secret_risk": secret,
        "reasons": F.array_join(more, "|"), "action": action,
    }
    return b.withColumns({k: F.when(judged, v).otherwise(F.col(k)) for k, v in new.items()}).drop("verdict", "judged", "judged_one_off", "judged_secret", "reason_codes")


def split_slug(slug: Column) -> Column:
    """The slug of what is split off a bundle."""
    tail = "-part-2"
    room = SLUG_CHARS - len(tail)
    head = F.when(F.length(slug) <= room, slug).otherwise(F.regexp_replace(F.substring(slug, 1, room), r"^-+|-+\z", ""))
    return F.when(slug == "", "split-skill").otherwise(F.concat(head, F.lit(tail)))


def split_evidence(rows: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Splits one piece of evidence off each bundle asked for: (keys, evidence_id), an empty id being the first.

    The outcome of each request - done, too_few or not_found - and the evidence with its `part`: 1 stays, 2 is split off.
    """
    known = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("evidence_id", F.struct("message_index", "evidence_id")).alias("first_id"))
    asked = requests.join(known, keys, "left").withColumn("wanted", F.when(F.coalesce("evidence_id", F.lit("")) == "", F.col("first_id")).otherwise(F.col("evidence_id")))
    there = rows.select(*keys, F.col("evidence_id").alias("wanted"), F.lit(True).alias("there"))
    asked = asked.join(there, [*keys, "wanted"], "left")
    outcome = F.when(F.coalesce("n", F.lit(0)) < 2, "too_few").when(F.col("there").isNull(), "not_found").otherwise("done")
    asked = asked.select(*keys, "wanted", outcome.alias("outcome"))
    done = asked.where("outcome = 'done'").select(*keys, "wanted")
    return asked.select(*keys, "outcome"), rows.join(done, keys).withColumn("part", F.when(F.col("evidence_id") == F.col("wanted"), 2).otherwise(1)).drop("wanted")


def publish_outcome(bundle: DataFrame) -> DataFrame:
    """Whether each bundle may be published, as `outcome`: ok, suppressed or sensitive."""
    n = F.size(F.filter(F.split("success_evidence", "\\|"), lambda e: e != ""))
    secret = (F.col("secret_risk") >= 0.75) | (T.secret_count(F.concat_ws("\n", "slug", "trigger", "instructions")) > 0)
    suppressed = (F.col("disposition") == "suppress") | (n < 1) | (F.col("one_off_risk") >= HIGH_RISK)
    return bundle.withColumn("outcome", F.when(suppressed, "suppressed").when(secret, "sensitive").otherwise("ok"))


def fallbacks(candidates: DataFrame) -> DataFrame:
    """How many candidates (reasons) were segmented by a fallback."""
    return candidates.agg(F.count_if(F.exists("reasons", lambda r: r.startswith("segment:fallback:"))).alias("n"))


def parse_markdown(document: Column, expected: Column) -> Column:
    """A skill's text form read back: a struct of name, description and `problem`, the first thing that is wrong, null if nothing is."""
    field = lambda x: T.trim_white(F.split_part(x, F.lit(":"), F.lit(1)))
    value = lambda head, name: F.transform(F.filter(head, lambda x: field(x) == name), lambda x: T.trim_white(F.substring(x, F.locate(":", x) + 1, F.length(x))))

    # Each part is worked out once a document, however often what follows names it.
    def of_lines(document: Column, lines: Column) -> Column:
        end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "---")
        return T.let(end, lambda end: T.let(_head(lines, end), lambda head: T.let(F.struct(value(head, "name").alias("names"), value(head, "description").alias("texts")), lambda v: of_head(document, lines, end, head, v["names"], v["texts"]))))

    def _head(lines: Column, end: Column) -> Column:
        return F.filter(F.slice(lines, 2, F.greatest((end - 1).cast("int"), F.lit(0))), lambda x: (x != "") & ~x.startswith("#"))

    def of_head(document: Column, lines: Column, end: Column, head: Column, names: Column, texts: Column) -> Column:
        name = F.regexp_replace(F.get(names, F.lit(0)), r'^"+|"+\z', "")
        raw = F.get(texts, F.lit(0))
        told = F.when(raw.startswith('"'), F.try_variant_get(F.try_parse_json(raw), "$", "string")).otherwise(raw)
        body = F.array_join(F.slice(lines, (end + 2).cast("int"), F.greatest(F.size(lines), F.lit(1))), "")
        problem = lambda name, told: (
            F.when(T.trim_white(F.coalesce(document, F.lit(""))) == "", "empty").when((F.size(lines) < 4) | (lines[0] != "---"), "no opening").when(end == 0, "no closing")
            .when(F.exists(head, lambda x: ~x.contains(":")), "malformed line").when(F.exists(head, lambda x: ~field(x).isin("name", "description")), "unsupported key")
            .when((F.size(names) != 1) | (F.get(names, F.lit(0)) == ""), "name").when((F.size(texts) != 1) | (raw == ""), "description").when(told.isNull(), "quoting")
            .when((F.length(name) > SLUG_CHARS) | ~T.matches(name, R.SLUG), "slug").when((expected != "") & (name != expected), "other name")
            .when((T.trim_white(told) == "") | (F.length(told) > 1024), "description").when(T.secret_count(document) > 0, "sensitive").when(T.trim_white(body) == "", "no body")
        )
        return T.let(F.struct(name.alias("name"), told.alias("told")), lambda v: F.struct(v["name"].alias("name"), v["told"].alias("description"), problem(v["name"], v["told"]).alias("problem")))

    lines = lambda document: F.transform(F.split(F.replace(document, F.lit("\r\n"), F.lit("\n")), "\n"), T.trim_white)
    return T.let(document, lambda d: T.let(lines(d), lambda x: of_lines(d, x)))


def extract_pending(messages: DataFrame, sessions: DataFrame, candidates: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """A candidate for each pending physical session: tool, session_id, source_path, slug, status (draft, rejected or failed), score.

    Its transcript are the messages of all sessions of the tool whose ids start with the session's own. Ids are looked up by all their
    prefixes, so that is an equi-join. A session without clean messages gives a failed candidate, so it is not tried again.
    """
    waiting = pending_sessions(sessions, candidates).select(*keys, "source_path")
    ids = waiting.select(*keys).distinct()
    known = messages.select(*keys).distinct()
    prefixes = known.select("tool", F.col("session_id").alias("member"), F.explode(F.transform(F.sequence(F.lit(1), F.length("session_id")), lambda n: T.ascii_lower(F.substring(F.col("session_id"), F.lit(1), n)))).alias("prefix"))
    met = ids.withColumn("prefix", T.ascii_lower(F.col("session_id"))).join(prefixes, ["tool", "prefix"]).select(*keys, "member")
    absorbed = messages.withColumnRenamed("session_id", "member").join(met, ["tool", "member"])
    made = bundles(absorbed, keys).select(*keys, "slug", F.when(F.col("disposition") == "suppress", "rejected").otherwise("draft").alias("status"), "score")
    rows = waiting.join(made, keys, "left")
    empty = cut_slug(T.slugify(F.concat(F.lit("empty-session-"), "session_id")))
    rows = rows.withColumns({"status": F.coalesce("status", F.lit("failed")), "score": F.coalesce("score", F.lit(0.0))})
    failed = rows.where("status = 'failed'").withColumn("slug", empty)
    return unique_slugs(rows.where("status <> 'failed'"), used, [*keys, "source_path"]).unionByName(failed)


def payload(bundle: DataFrame, columns: list[str]) -> DataFrame:
    """Bundles with their JSON form in `payload`."""
    return bundle.withColumn("payload", F.to_json(F.struct(*columns)))


def from_payload(candidates: DataFrame, schema: str) -> DataFrame:
    """Candidates with the bundle in their payload; null where that is no bundle."""
    return candidates.withColumn("bundle", F.from_json("payload", schema))


def streamed_digest(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `digest`, the SHA-256 of a session's title and of role and text of its messages in order, all parted by zero characters.

    The messages stream through the task that digests them, however many there are; none are held.
    """
    order = [F.coalesce("ts", F.lit(0.0)), F.col("id"), F.col("role"), F.col("text")]
    rows = messages.select(*keys, "title", "ts", "id", "role", "text").repartition(*keys).sortWithinPartitions(*keys, *order).drop("ts", "id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        put = lambda done: pa.RecordBatch.from_pylist([{**dict(zip(keys, k, strict=True)), "digest": d} for k, d in done])
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                session = tuple(row[k] for k in keys)
                if session != now:
                    done += [(now, sha.hexdigest())] if now is not None else []
                    now, sha = session, hashlib.sha256((row["title"] or "").encode())
                if row["role"] is not None and row["text"] is not None:
                    sha.update(f"\0{row['role']}\0{row['text']}".encode())
            if done:
                yield put(done)
        if now is not None:
            yield put([(now, sha.hexdigest())])

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", digest string")


def bundles(messages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session with messages: the quality gate's columns, title, slug, trigger, risks and instructions."""
    m = clean_messages(messages)
    place = F.struct(F.coalesce("ts", F.lit(0.0)), "id")
    first = m.groupBy(*keys).agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", place)).alias("first_user"))
    titles = session_rollup(messages).groupBy(*keys).agg(F.coalesce(F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.struct("created", "source_path"))), F.lit("")).alias("title"))
    known = quality_gate(signal_bundle(messages, keys)).join(first, keys).join(titles, keys).join(instructions(m, keys), keys, "left")
    known = known.withColumn("plain", T.slugify(F.col("title")))
    # Only sessions without a usable title need a digest.
    bare = known.where(F.length("plain") < LEAST_SLUG).select(*keys)
    digests = streamed_digest(m.join(bare, keys, "left_semi").join(known.where(F.length("plain") < LEAST_SLUG).select(*keys, "title"), keys), keys)
    out = known.join(digests, keys, "left")
    named = F.concat(F.lit("skill-"), F.substring("digest", 1, 8))
    slug = cut_slug(F.when(F.length("plain") < LEAST_SLUG, named).otherwise(F.col("plain")))
    return out.select(
        *keys, "title", slug.alias("slug"), trigger(F.col("first_user"), F.col("intent")).alias("trigger"), F.coalesce("instructions", F.lit("")).alias("instructions"),
        F.array_join(risks(F.col("success_evidence"), F.col("one_off_risk"), F.col("secret_risk"), F.col("intent")), "|").alias("risks"), "disposition", "score",
    )


def unique_slugs(rows: DataFrame, used: DataFrame, order: list[str], slug: str = "slug") -> DataFrame:
    """Replaces slugs that are taken: by earlier rows with the same, or in `used` (slug). Numbers are tried from 2 on.

    The first row of a slug keeps it if it is free; the r-th of the others gets the r-th free number. To find these, as many numbers are
    listed as there are rows and used slugs of that stem together, so one pass is enough. Long slugs are cut to make room for the number;
    those that agree in all that is left then share one count.
    """
    room = SLUG_CHARS - 8

    def stem(s: Column) -> Column:
        return cut_slug(s, room)

    mine = Window.partitionBy(slug).orderBy(*order)
    taken = used.select(F.col("slug").alias("taken")).where("taken IS NOT NULL").distinct()
    ranked = rows.withColumn("nth", F.row_number().over(mine)).join(taken, F.col(slug) == F.col("taken"), "left")
    free = (F.col("nth") == 1) & F.col("taken").isNull()
    kept = ranked.where(free).drop("nth", "taken")
    others = ranked.where(~free).drop("nth", "taken").withColumn("stem", stem(F.col(slug)))
    others = others.withColumn("nth", F.row_number().over(Window.partitionBy("stem").orderBy(slug, *order)))
    blocked = taken.select(F.col("taken").alias("name")).unionByName(rows.select(F.col(slug).alias("name"))).distinct()
    blocked = blocked.withColumn("tail", F.regexp_extract("name", r"-([0-9]{1,18})\z", 1)).where("tail <> ''")
    blocked = blocked.select(stem(F.regexp_replace("name", r"-[0-9]{1,18}\z", "")).alias("stem"), F.col("tail").cast("long").alias("number")).distinct()
    counts = others.groupBy("stem").agg(F.count("*").alias("n")).join(blocked.groupBy("stem").agg(F.count("*").alias("b")), "stem", "left")
    numbers = counts.select("stem", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n") + F.coalesce("b", F.lit(0)) + 1)).alias("number")).join(blocked, ["stem", "number"], "left_anti")
    numbers = numbers.withColumn("nth", F.row_number().over(Window.partitionBy("stem").orderBy("number")))
    tail = F.concat(F.lit("-"), F.col("number").cast("string"))
    renamed = others.join(numbers, ["stem", "nth"]).withColumn(slug, F.concat(cut_slug(F.col(slug), F.lit(SLUG_CHARS) - F.length(tail)), tail))
    return kept.unionByName(renamed.select(*kept.columns))


def markdown(bundle: DataFrame) -> DataFrame:
    """Bundles with their text form in `document`; null where it would hold a secret."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    body = F.concat(F.lit("---\nname: "), F.col("slug"), F.lit("\ndescription: "), quoted("trigger"), F.lit("\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.col("instructions"), F.lit("\n"))
    return bundle.withColumn("document", F.when(T.secret_count(body) == 0, body))


def publish(bundle: DataFrame, path: str) -> None:
    """Writes the documents of drafted bundles, a folder for each slug's first character, from the tasks that hold them."""
    ready = markdown(bundle).where("disposition = 'draft' AND document IS NOT NULL").select("slug", "document", F.substring("slug", 1, 1).alias("shelf"))
    ready.write.mode("overwrite").partitionBy("shelf").parquet(path)


# Answers on windows of user turns ---------------------------------------------------------------------------------------------------------

# Why a session was not segmented as asked for.
MISSING_INDEX, SEGMENTER_ERROR, EMPTY_RESULT = "missing_index", "segmenter_error", "empty_result"


def turns_of_answers(sessions: DataFrame, windows: DataFrame, answers: DataFrame, errors: DataFrame, keys: list[str], overlap: int = 1) -> tuple[DataFrame, DataFrame]:
    """Decisions (keys, turn, decision) from answers on overlapping windows, and observations on what was repaired or given up.

    Windows are those of windows.turn_windows(); answers are (keys, window, index, decision, place), of which the last by place counts and
    those outside the window don't; errors are (keys, window, error). Where windows overlap, the earlier one's answer is taken. A turn
    without an answer goes on with the task before it; the first turn of a session always starts one. A session with an error has no
    decisions, so it stays one task; its observations are those up to the first error. A session without turns is an empty result.

    Observations are (keys, kind, count, window_start, window_end, message), by window and not by turn. Null or empty decisions are none.
    """
    failed = errors.groupBy(*keys).agg(F.min("window").alias("failed_at"), F.min_by("error", "window").alias("message"))
    every = windows.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    told = answers.where("coalesce(decision, '') <> ''").groupBy(*keys, F.col("window").cast("long").alias("window"), F.col("index").cast("long").alias("index")).agg(F.max_by("decision", "place").alias("decision"))
    met = every.join(told, [*keys, "window", "index"], "left").join(failed.select(*keys, "failed_at"), keys, "left")
    turn = F.col("first_turn") + F.col("index")
    own = F.col("failed_at").isNull() & ((F.col("window") == 0) | (F.col("index") >= overlap))
    decision = F.when(turn == 0, "new").otherwise(F.coalesce("decision", F.lit("same")))
    turns = met.where(own).select(*keys, turn.alias("turn"), decision.alias("decision"))
    before = met.where(F.col("failed_at").isNull() | (F.col("window") < F.col("failed_at")))
    repaired = before.groupBy(*keys, "window", "first_turn", "turns").agg(F.count_if(F.col("decision").isNull()).alias("count")).where("count > 0")
    empty = sessions.select(*keys).distinct().join(windows.select(*keys).distinct(), keys, "left_anti")
    seen = repaired.select(*keys, F.lit(MISSING_INDEX).alias("kind"), "count", F.col("first_turn").alias("window_start"), (F.col("first_turn") + F.col("turns") - 1).alias("window_end"), F.lit("").alias("message"))
    for rows, kind, message in ((failed, SEGMENTER_ERROR, F.col("message")), (empty, EMPTY_RESULT, F.lit(""))):
        zero = F.lit(0).cast("long")
        seen = seen.unionByName(rows.select(*keys, F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("count"), zero.alias("window_start"), zero.alias("window_end"), F.coalesce(message, F.lit("")).alias("message")))
    return turns, seen


def fallback_reasons(observations: DataFrame, keys: list[str]) -> DataFrame:
    """The reasons (keys, reasons) that observations add to the candidates of a session, each once: no more than a window has turns, and two."""
    one = F.concat(F.lit("segment:fallback:"), "kind", F.when(F.col("count") > 0, F.concat(F.lit(":"), F.col("count").cast("string"))).otherwise(""))
    return observations.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("reasons"))
