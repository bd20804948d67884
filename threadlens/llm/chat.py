"""Chat formatting: final messages are rebuilt from a log of events, then rendered.

A log has events of a conversation in the order of `seq`:

* message: opens message `message_id` with a role and a text;
* delta: appends its text to that message (streaming);
* edit: replaces its text;
* regenerate: empties it, or sets it to the event's text; deltas that follow build it anew.

fold_events() sorts the events of each message and folds them: windows number the openings and restarts, and the pieces of the last run
are joined once, so many deltas cost no more than their length. render() ranges the messages over partitions by
conversation and position, so even one conversation with a third of all rows is spread, and writes each run of a conversation within
a partition as blocks of bounded size. A conversation's formatted text is its blocks, one after another.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts, `<`, any number of backslashes and `|` in a row get one
more backslash, so no control string can occur, and taking one away restores them. In roles, backslashes and line feeds are written
as `\\\\` and `\\n` before that.

read_back() parses the blocks again. A conversation that lies in one block is digested where it is read. Of one with several blocks
only the places of the blocks are gathered; one task then streams these from the shared folder in order, as a digest of the whole
needs them one after another, and holds one block at a time.

Defined results: null roles and texts are empty; rows that tie in conversation and turn are all kept, in the order of role and text;
events that name no opened message open one with an empty role; a null conversation is one of its own; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_folder, stage

START, END = "<|im_start|>", "<|im_end|>"

#: A block ends with the message that brings it to this many characters.
BLOCK_CHARS = 1 << 18


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_message(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(block: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the escaped text of each message of a block."""
    out, at = [], 0
    while at < len(block):
        head = block.index("\n", at)
        end = block.index(END, head)
        if not block.startswith(START, at):
            raise ValueError("a block does not start with a message")
        out.append((unescape_role(block[at + len(START) : head]), unescape(block[head + 1 : end]), head + 1, end))
        at = end + len(END) + 1
    return out


def fold_events(events: DataFrame) -> DataFrame:
    """From events (conv_id, message_id, seq, kind, role, text): messages (conv_id, turn, role, text), turn being the least seq."""
    e = events.select("conv_id", "message_id", F.col("seq").cast("long").alias("seq"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opens = (F.col("kind") == "message").eqNullSafe(F.lit(True))
    order = Window.partitionBy("conv_id", "message_id").orderBy("seq", (~opens).cast("int"), "role", "text", "kind")
    e = e.withColumn("place", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("place") == 1
    # A message's text is what its last opening, edit or regeneration says and the deltas after that.
    e = e.withColumns({"opened": F.sum((opens | first).cast("int")).over(upto), "restart": F.sum(((F.col("kind") != "delta").eqNullSafe(F.lit(True)) | first).cast("int")).over(upto)})
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "")
    runs = e.groupBy("conv_id", "message_id", "opened", "restart").agg(F.min("seq").alias("turn"), F.min_by("role", "place").alias("role"), said.alias("text"))
    folded = runs.groupBy("conv_id", "message_id", "opened").agg(F.min("turn").alias("turn"), F.min_by("role", "restart").alias("role"), F.max_by("text", "restart").alias("text"))
    return folded.select("conv_id", "turn", "role", "text")


def render(messages: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Blocks (conv_id, part, block, formatted, starts, ends) of messages (conv_id, turn, role, text), written to the shared folder.

    `starts` and `ends` are the loss mask: the character spans of the assistant texts in `formatted`. Blocks of a conversation are in
    the order of part and block.
    """
    spark = messages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = stage(keyed, "messages").repartitionByRange(n, "conv_id", "turn", F.xxhash64("role", "text")).sortWithinPartitions(*order)
    rows = ranged.select(F.spark_partition_id().alias("part"), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        spans: list[tuple[int, int]] = []
        conv, part, block, size = None, 0, 0, 0
        ready: list[tuple] = []

        def close() -> None:
            nonlocal held, spans, size, block
            if held:
                ready.append((conv, part, block, "".join(held), [a for a, _ in spans], [b for _, b in spans]))
                held, spans, size, block = [], [], 0, block + 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "block", "formatted", "starts", "ends"])

        for batch in batches:
            for p, c, role, text in zip(*(batch.column(k).to_pylist() for k in ("part", "conv_id", "role", "text")), strict=True):
                if c != conv or size >= BLOCK_CHARS:
                    close()
                conv, part = c, p
                message = format_message(role, text)
                if role == "assistant":
                    end = size + len(message) - len(END) - 1
                    spans.append((size + len(START) + len(role) + 1, end))
                held.append(message)
                size += len(message)
            if sum(len(r[3]) for r in ready) >= BLOCK_CHARS:
                yield out()
                ready.clear()
        close()
        if ready:
            yield out()

    return stage(rows.mapInArrow(run, "conv_id long, part int, block long, formatted string, starts array<long>, ends array<long>"), "blocks")


class _Digest:
    """What is read back of one conversation, block by block."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for a, b in zip(starts, ends, strict=True):
            text = unescape(formatted[a:b])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_DIGEST_TYPE = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _DIGEST_NAMES)


def read_back(blocks: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed from blocks as render() wrote them."""
    places = blocks.select("conv_id", "part", F.col("_metadata.file_path").alias("file"))
    split = stage(
        places.groupBy("conv_id", "part", "file").count().groupBy("conv_id").agg(F.sum("count").alias("n"), F.collect_list(F.struct("part", "file")).alias("files")).where("n > 1"),
        "split-conversations",
    )
    names = split.select(F.col("conv_id").alias("split_id"))
    single = blocks.join(names, blocks["conv_id"].eqNullSafe(names["split_id"]), "left_anti").select("conv_id", "formatted", "starts", "ends")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "starts", "ends")), strict=True):
                digest = _Digest()
                digest.add(formatted, starts, ends)
                rows.append((conv, *digest.row()))
            yield _digest_rows(rows)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, files in zip(batch.column("conv_id").to_pylist(), batch.column("files").to_pylist(), strict=True):
                digest = _Digest()
                for place in sorted(files, key=lambda f: f["part"]):
                    for formatted, starts, ends in _blocks_in(place["file"], conv):
                        digest.add(formatted, starts, ends)
                rows.append((conv, *digest.row()))
            yield _digest_rows(rows)

    return single.mapInArrow(one, _DIGEST_TYPE).unionAll(split.select("conv_id", "files").mapInArrow(several, _DIGEST_TYPE))


def _blocks_in(file: str, conv: int | None) -> Iterator[tuple[str, list[int], list[int]]]:
    """The blocks of a conversation in one file, in order: a file holds one part, whose blocks are in order."""
    fs, path = open_folder(unquote(file) if file.startswith("file:") else file)
    with fs.open_input_file(path) as f:
        source = pq.ParquetFile(f)
        column = source.schema_arrow.get_field_index("conv_id")
        for g in range(source.num_row_groups):
            stats = source.metadata.row_group(g).column(column).statistics
            if conv is not None and stats is not None and stats.has_min_max and not stats.min <= conv <= stats.max:
                continue
            for batch in source.iter_batches(16, row_groups=[g], columns=["conv_id", "formatted", "starts", "ends"]):
                ids = batch.column("conv_id")
                mine = ids.is_null() if conv is None else ids.fill_null(0).to_numpy() == conv
                for i in np.flatnonzero(mine).tolist():
                    yield batch.column("formatted")[i].as_py(), batch.column("starts")[i].as_py(), batch.column("ends")[i].as_py()
