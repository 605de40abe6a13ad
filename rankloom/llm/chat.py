r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is
trainable.  Where a conversation does not end with an assistant turn, one more example without a trainable
part holds the whole conversation, so that every turn can be read back.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` for each turn.  Inside texts and roles each ``<|`` gets a
backslash, ``<\|``, and each ``<\..\|`` one more, so no control string of a text survives and unescaping
takes exactly one backslash away.  In roles, backslashes and line breaks are escaped first.

Turns are sorted by conversation and read as a stream that renders each turn once.  After every `SECTION_TURNS`
turns of a conversation, and at its end, one row goes on with the text so far and the places of the targets among
these turns; such rows are dealt out over all tasks, and each makes the examples of its own targets.  So the
examples of a long conversation, whose text grows with the square of its turns, are written by many tasks, and the
one that reads all its turns hands on a row for each section only.

Cases: null roles and texts are empty; turns with the same number are ordered by role, then text; repeated
rows are repeated turns; rows without a conv_id form one conversation; a conversation of one row works like
any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need, partitions

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

#: Turns of a conversation whose examples one task makes.
SECTION_TURNS = 256
#: Characters of examples that are handed on together.
BATCH_CHARS = 4 << 20
_TARGET = pa.struct([("loss_start", pa.int64()), ("loss_end", pa.int64()), ("size", pa.int64()), ("n_turns", pa.int32())])
SECTIONS = pa.schema([("conv_id", pa.int64()), ("first", pa.int32()), ("text", pa.string()), ("targets", pa.list_(_TARGET))])
SECTIONS_DDL = "conv_id long, first int, text string, targets array<struct<loss_start:long,loss_end:long,size:long,n_turns:int>>"
SCHEMA = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_turns", pa.int32())])
DDL = "conv_id long, example int, text string, loss_start long, loss_end long, n_turns int"
RUNS = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("trained", pa.string()), ("chars", pa.int64()), ("text", pa.string())])
RUNS_DDL = "conv_id long, example int, trained string, chars long, text string"
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


class Conversation:
    """Renders a conversation turn by turn and hands it on in sections: the text so far and the targets since the last one.

    A target has loss_start and loss_end, the size of its example, and n_turns, the turns in it.
    """

    def __init__(self) -> None:
        self.pieces, self.size, self.turns, self.trained = [], 0, 0, False
        self.first, self.targets, self.here = 0, [], 0

    def target(self, start: int, end: int) -> None:
        self.targets.append({"loss_start": start, "loss_end": end, "size": self.size, "n_turns": self.turns})

    def add(self, role: str, text: str) -> None:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        start = self.size + len(head)
        self.pieces.append(f"{head}{body}{END}\n")
        self.size += len(self.pieces[-1])
        self.turns += 1
        self.here += 1
        self.trained = role == TRAINED_ROLE
        if self.trained:
            self.target(start, start + len(body))

    def section(self, last: bool) -> tuple | None:
        """(number of its first example, text so far, targets), if it has a target; the last one may end with an example without a trainable part."""
        if last and self.turns and not self.trained:
            self.target(0, 0)
        first, targets = self.first, self.targets
        self.first, self.targets, self.here = first + len(targets), [], 0
        if not targets:
            return None
        self.pieces = ["".join(self.pieces)]
        return first, self.pieces[0], targets


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of an example, unescaped."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)]


def _sections(section_turns: int):
    """Sections of the conversations of a partition that is sorted by them."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SECTIONS)], schema=SECTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, made, size = None, None, [], 0

        def close(last: bool) -> None:
            nonlocal size
            if known and (got := known.section(last)):
                made.append((now, *got))
                size += len(got[1])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if known is None or conv != now:
                    close(True)
                    now, known = conv, Conversation()
                elif known.here >= section_turns:
                    close(False)
                known.add(role, text)
                if size > BATCH_CHARS:
                    yield batch_of(made)
                    made, size = [], 0
        close(True)
        if made:
            yield batch_of(made)

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of sections; at most about `BATCH_CHARS` at a time."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    made, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            conv, first, line, targets = (column[i].as_py() for column in batch.columns)
            for example, t in enumerate(targets, first):
                made.append((conv, example, line[: t["size"]], t["loss_start"], t["loss_end"], t["n_turns"]))
                size += t["size"]
                if size > BATCH_CHARS:
                    yield batch_of(made)
                    made, size = [], 0
    if made:
        yield batch_of(made)


def format_conversations(turns: DataFrame, section_turns: int = SECTION_TURNS) -> DataFrame:
    """A row for each example, from rows (conv_id, turn, role, text): conv_id, example (from 0), text, loss_start, loss_end, n_turns.

    Examples of a section follow each other, in order, within a partition.
    """
    need(turns, "conv_id", "turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions(turns.sparkSession)
    sections = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lean(_sections(section_turns)), SECTIONS_DDL)
    return sections.repartition(parts, "conv_id", "first").sortWithinPartitions("conv_id", "first").mapInArrow(lean(_expand), DDL)


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of examples that follow each other: what is under their loss masks, their size, and the last of them."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), RUNS)], schema=RUNS)

    run, out, weight = None, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            conv, example, text, start, end = (batch.column(c)[i].as_py() for c in range(5))
            if run is None or conv != run[0] or example != run[2] + 1:
                if run is not None:
                    out.append((*run[:2], "".join(run[3]), *run[4:]))
                    weight += len(run[5])
                run = [conv, example, example, [], 0, ""]
            run[2], run[4], run[5] = example, run[4] + len(text), text
            run[3].append(unescape(text[start:end]))
            if weight > BATCH_CHARS:
                yield batch_of(out)
                out, weight = [], 0
    if run is not None:
        yield batch_of([*out, (*run[:2], "".join(run[3]), *run[4:])])


def digest(formatted: DataFrame) -> DataFrame:
    """What the examples say, read back from them, as one row for each conversation.

    Takes the examples in any order.  Those that follow each other are put together where they are; only the texts
    under their masks and the last of them go on to the task of their conversation.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, loss_chars, loss, size, out = None, None, 0, hashlib.sha256(), 0, []

        def row() -> tuple:
            turns = parse(last)  # the last example holds all turns
            said = hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode())
            return now, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), size

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), DIGEST)], schema=DIGEST)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, trained, chars, text = (batch.column(c)[i].as_py() for c in (0, 2, 3, 4))
                if last is not None and conv != now:
                    out.append(row())
                    loss_chars, loss, size = 0, hashlib.sha256(), 0
                loss.update(trained.encode())
                now, last, loss_chars, size = conv, text, loss_chars + len(trained), size + chars
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if last is not None:
            yield batch_of([*out, row()])

    runs = formatted.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(lean(_digest_runs), RUNS_DDL)
    parts = partitions(formatted.sparkSession)
    return runs.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(lean(combine), DIGEST_DDL)
