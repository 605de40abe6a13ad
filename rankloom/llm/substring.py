"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted over the whole corpus.

Three steps, with one exchange of window hashes:

1. Map tasks roll a Rabin-Karp hash over the words of each text, count the hashes of a block of documents
   (a partial aggregation: a passage that a third of the corpus shares leaves one hash a block), and send
   each distinct hash once, packed by hash range.  Hashes met twice within the block are known to repeat.
2. Each hash range counts its hashes over all blocks and answers which entries of which block repeat.
3. Each block turns its repeated windows into maximal intervals of words, a row for each document with any.

The text itself is never shuffled by hash.  Intervals come back to the documents by the row's key.

Cases: a null text has no words; a text shorter than the window has no window and loses nothing; equal rows
count as copies of each other, so both lose their windows; an empty table gives an empty result; other
columns of the input pass through unread.  Two different windows are taken for equal only if their 64-bit
hashes meet (about n*n/2**65 for n windows).  As the places of windows are counted within a map task, the
input must give the same rows in the same order when a lost task runs again: a table that is read does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, buckets, cut, input_bytes, lean, lookup, need, packed, row_key, unpacked

WINDOW = 35
#: Words of a block: bounds the memory of a map task; a longer document is a block of its own.
BLOCK_WORDS = 1_000_000
#: Bytes of packed hashes that a task should hold, how many times the input they are at most, and the least that a row should have.
RANGE_BYTES, ENTRY_RATIO, ENTRIES_A_ROW = 64 << 20, 3, 64
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPANS = "array<struct<first:int,last:int>>"


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each `length` consecutive word hashes.

    The hash of a+b words is hash(a) * BASE**b + hash(b), so doubling builds all windows in log2(length) passes.
    """
    if len(words) < length:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, size, power = words, 1, BASE
        whole, done = None, 0
        while True:
            if length & size:
                n = len(words) - (done + size) + 1
                if whole is None:
                    whole = part[:n]
                else:
                    whole = whole[:n] * power + part[done : done + n]
                done += size
            if done == length:
                break
            part = part[: len(part) - size] * power + part[size:]
            size, power = size * 2, power * power
        whole = whole ^ (whole >> np.uint64(32))
        whole = whole * np.uint64(0xD6E8FEB86659FD93)
        return whole ^ (whole >> np.uint64(29))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pack(values: np.ndarray) -> tuple[bytes, int]:
    """Unsigned integers in as few whole bytes each as the largest needs."""
    top = int(values.max()) if len(values) else 0
    size = max(1, (top.bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes(), size


def _unpack(data: bytes, size: int) -> np.ndarray:
    got = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :size] = got
    return out.view("<u8").ravel()


PACKED = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("size_a", pa.int32()), ("size_b", pa.int32())]
)
PACKED_DDL = "bucket int, block long, kind int, a binary, b binary, c binary, size_a int, size_b int"
DIRECTORY, ENTRIES, ANSWER = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PACKED)], schema=PACKED)


def _emit(length: int, n_buckets: int, block_words: int):
    def block_rows(block: int, keys: list[tuple[int, int]], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in hashes], np.int64)
        ends = np.cumsum(sizes)
        every = window_hashes(np.concatenate(hashes), length)
        starts = np.arange(len(every))
        end = np.repeat(ends, sizes)[: len(every)]
        starts = starts[starts + length <= end]
        if not len(starts):
            return
        every = every[starts]
        order = np.argsort(every, kind="stable")
        every, starts = every[order], starts[order]
        first = np.r_[True, every[1:] != every[:-1]]
        run = np.cumsum(first) - 1
        many = np.bincount(run) > 1
        known = np.sort(starts[many[run]])
        every, starts = every[first], starts[first]
        # The hash ranges are contiguous in the sorted hashes.
        bounds = np.searchsorted(every, np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], np.uint64))
        gaps, size_gap = _pack(np.diff(known, prepend=0))
        directory = np.array(keys, np.int64).reshape(-1, 2).tobytes()
        yield _rows([(xxhash.xxh3_64_intdigest(block.to_bytes(8, "little")) % n_buckets, block, DIRECTORY, directory, ends.astype("<i8").tobytes(), gaps, 0, size_gap)])
        out, weight = [], 0
        for bucket, (i, j) in enumerate(zip(np.r_[0, bounds], np.r_[bounds, len(every)])):
            if i == j:
                continue
            low = np.uint64((bucket << 64) // n_buckets)
            a, size_a = _pack(np.diff(every[i:j], prepend=low))
            b, size_b = _pack(starts[i:j])
            out.append((bucket, block, ENTRIES, a, b, np.packbits(many[i:j]).tobytes(), size_a, size_b))
            weight += len(a) + len(b)
            if weight > 8 << 20:
                yield _rows(out)
                out, weight = [], 0
        if out:
            yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, hashes, total = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                got = word_hashes(text.as_py())
                if len(got) < length:
                    continue
                if total and total + len(got) > block_words:
                    yield from block_rows(block, keys, hashes)
                    block, keys, hashes, total = block + 1, [], [], 0
                keys.append((k1[i], k2[i]))
                hashes.append(got)
                total += len(got)
        if total:
            yield from block_rows(block, keys, hashes)

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows with one key; the partition is sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _count(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            passed = [r for r in rows if r["kind"] == DIRECTORY]
            if passed:
                yield _rows([tuple(r[f.name] for f in PACKED) for r in passed])
            rows = [r for r in rows if r["kind"] == ENTRIES]
            if not rows:
                continue
            low = np.uint64((bucket << 64) // n_buckets)
            with np.errstate(over="ignore"):
                each = [np.cumsum(_unpack(r["a"], r["size_a"]), dtype=np.uint64) + low for r in rows]
            lengths = [len(x) for x in each]
            twice = np.concatenate([np.unpackbits(np.frombuffer(r["c"], np.uint8), count=n) for r, n in zip(rows, lengths)]).astype(bool)
            every = np.concatenate(each)
            del each
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.r_[True, every[1:] != every[:-1]]
            run_of = np.cumsum(first) - 1
            repeated = np.empty(len(every), bool)
            repeated[order] = (np.bincount(run_of) > 1)[run_of]
            repeated &= ~twice  # those are known in their block
            at, out = 0, []
            for r, n in zip(rows, lengths):
                hit = repeated[at : at + n]
                at += n
                if hit.any():
                    b, size_b = _pack(np.sort(_unpack(r["b"], r["size_b"])[hit]))
                    out.append((bucket, r["block"], ANSWER, None, b, None, 0, size_b))
            if out:
                yield _rows(out)

    return run


def _intervals(length: int):
    schema = pa.schema([(KEY[0], pa.int64()), (KEY[1], pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            where = next(r for r in rows if r["kind"] == DIRECTORY)
            keys = np.frombuffer(where["a"], np.int64).reshape(-1, 2)
            ends = np.frombuffer(where["b"], np.int64)
            known = np.cumsum(_unpack(where["c"], where["size_b"])).astype(np.int64)
            starts = np.sort(np.concatenate([known, *(_unpack(r["b"], r["size_b"]).astype(np.int64) for r in rows if r["kind"] == ANSWER)]))
            if not len(starts):
                continue
            doc = np.searchsorted(ends, starts, side="right")
            # A new interval begins where a window does not touch the one before it, or another document begins.
            new = np.r_[True, (starts[1:] > starts[:-1] + length) | (doc[1:] != doc[:-1])]
            at = np.flatnonzero(new)
            base = np.r_[0, ends[:-1]]
            doc, first, last = doc[at], starts[at], np.r_[starts[at[1:] - 1], starts[-1]] + length - 1
            first, last = first - base[doc], last - base[doc]
            docs, offsets = np.unique(doc, return_index=True)
            spans = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["first", "last"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[docs, 0]), pa.array(keys[docs, 1]), pa.ListArray.from_arrays(pa.array(np.r_[offsets, len(first)].astype(np.int32)), spans)], schema=schema
            )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, spans): for each row with repeated windows, the maximal intervals of words to remove, both ends included."""
    need(docs, "doc_id", "text")
    # A range of hashes is held by one task at a time; larger blocks keep what they send to a range worth a row.
    n = max(buckets(docs.sparkSession), input_bytes(docs.select("text")) * ENTRY_RATIO // RANGE_BYTES)
    block_words = max(block_words, ENTRIES_A_ROW * n) if block_words >= BLOCK_WORDS else block_words
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    entries = keyed.mapInArrow(lean(_emit(window, n, block_words)), PACKED_DDL)
    answers = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(_count(n)), PACKED_DDL)
    spans = answers.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(lean(_intervals(window)), f"{KEY[0]} long, {KEY[1]} long, spans {SPANS}")
    return spans.dropDuplicates(list(KEY))


def with_spans(docs: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, bound: int | None = None) -> DataFrame:
    """doc_id, text and `spans`, the word intervals to remove (null: none), of each row, with the row as a struct `__row`."""
    found = cut(repeated_spans(docs, window, block_words), 8)
    return lookup(packed(docs), found, list(KEY), bound=bound)


def split_words(text: bytes, spans: list[dict]) -> list[bytes]:
    words, out, at = text.split(), [], 0
    for s in spans:
        out += words[at : s["first"]]
        at = s["last"] + 1
    return out + words[at:]


def cut_text(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans, each with the white space after it."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data)]
    out, kept = [], 0
    for s in spans:
        out.append(data[kept : at[s["first"]][0]])
        kept = at[s["last"] + 1][0] if s["last"] + 1 < len(at) else len(data)
    return b"".join([*out, data[kept:]]).decode()


def digest(docs_with_spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of documents with their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                text = text.as_py() or b""
                words = text.split()
                left = split_words(text, spans) if spans else words
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = docs_with_spans.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return out.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, bound: int | None = None) -> DataFrame:
    """The documents with their repeated passages cut from `text`; columns and rows stay, clean texts byte for byte.

    Where there is a column `n_chars`, it follows the changed texts.  Only texts that change go to Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [cut_text(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["__row", "new"])

    marked = with_spans(docs, window, bound=bound)
    untouched = unpacked(marked.where("spans is null"), docs.columns)
    rows = marked.where("spans is not null").select("__row", "text", "spans")
    schema = T.StructType([rows.schema["__row"], T.StructField("new", T.StringType())])
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return untouched.unionAll(unpacked(rows.mapInArrow(lean(run), schema), docs.columns, **changed))
