"""Token counts by heap-and-linked-list byte-pair merging over a SentencePiece BPE model.

Symbols form a linked list; a heap holds the adjacent pairs whose concatenation is a piece, best score (lowest
rank) and leftmost first.  Each pop that is still valid merges two symbols and pushes the new neighbours.  The
count is the number of initial symbols less the merges, where a character outside the vocabulary counts as
its UTF-8 bytes (byte fallback).  No identifier is looked up.

Merges never cross two kinds of place: before a white-space mark that follows something else, if no piece
holds a mark after another character, and around a character that is in no longer piece.  Texts are cut
there, which changes no count, and the counts of short cuts are remembered by each worker.

Cases: null and empty texts have 0 tokens; very long runs without a cut merge in n log n and are not
remembered; equal rows give equal rows; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, need

MARK = "▁"
LIMIT = 4096
#: Remembered cuts of a worker and the longest of them: bound its memory at about 150 MB.
REMEMBERED, LONGEST = 600_000, 48


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message: number and value (bytes, integer, or 4/8 raw bytes)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Pieces with scores and the normalisation of a SentencePiece BPE model with byte fallback."""

    NORMAL, USER_DEFINED, UNUSED = 1, 4, 5

    def __init__(self, data: bytes) -> None:
        self.rank: dict[str, float] = {}
        self.prefix = self.fallback = False
        self.prefix = True
        kind = 1
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                if got.get(3, self.NORMAL) in (self.USER_DEFINED, self.UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
                if got.get(3, self.NORMAL) == self.NORMAL:
                    self.rank[got[1].decode()] = -struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            elif number == 2:
                got = dict(_fields(value))
                kind, self.fallback = got.get(3, 1), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                if got.get(2):
                    raise ValueError("only identity normalisation is supported")
                if got.get(4, 1) or not got.get(5, 1):
                    raise ValueError("only models that keep extra white space and mark it are supported")
                self.prefix = bool(got.get(3, 1))
        if kind != 2 or not self.fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        longer = [p for p in self.rank if len(p) > 1]
        active = re.escape("".join(sorted({c for p in longer for c in p if c != MARK})))
        self.cut = None
        if not any(MARK in p.lstrip(MARK) for p in longer):
            self.cut = re.compile(f"{MARK}*[{active}]+|{MARK}+|.", re.DOTALL)

    def merged(self, text: str) -> int:
        """Tokens of a text after normalisation."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = symbols[i]
            if a is None or (j := right[i]) < 0 or len(a) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + symbols[j], None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := rank.get(both := symbols[x] + symbols[y])) is not None:
                    heapq.heappush(heap, (r, x, len(both)))
        return sum(1 if s in rank else len(s.encode()) for s in symbols if s is not None)


class Counter(dict):
    """Remembered counts of cuts."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, cut: str) -> int:
        n = self.model.merged(cut)
        if len(cut) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[cut] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = (MARK if self.model.prefix else "") + text.replace(" ", MARK)
        return self.model.merged(text) if self.model.cut is None else sum(map(self.__getitem__, self.model.cut.findall(text)))


_counters: dict[int, Counter] = {}


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """A model file, read through Spark, so that it may lie in any store."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"])


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row. The model (under a MB) is sent to the workers."""
    need(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _counters:
            _counters[key] = Counter(PieceModel(sent.value))
        count = _counters[key].count
        for batch in batches:
            n = pa.array([count(x.as_py()) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
