"""SimHash near-dedup by anchor points of a covering code.

Fingerprints have 64 bits over XXH64 hashes of 3-word shingles and link at 3 or fewer differing bits.  Of two
such fingerprints one 32-bit half differs in at most one bit, so each half is searched at threshold 1.  The
anchors of a half are the codewords of a covering code: the perfect binary Golay code of length 23 (every
word lies within 3 of exactly one codeword) on 23 bits, times the identity code (radius 0) on the other 9.
A fingerprint is copied to every anchor within covering radius plus threshold: to the codewords within 3 + 1
on the Golay part with its own 9 bits, and to its nearest codeword with one of the 9 bits cleared (the
fingerprint that has the bit cleared waits there).  About 21 copies of each distinct fingerprint replace a
comparison with all others, and no link is lost.

Exact copies meet first: one row for each distinct fingerprint goes on.  At an anchor, comparisons feed a
forest, so a task emits at most one edge for each fingerprint that it links, never all pairs of a group.

Cases: null, empty and white-space texts have fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; equal rows get the same component; a null doc_id counts as larger than any other,
and a component of nulls alone has component_id null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, cut, lean, lookup, need, packed, unpacked
from .components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
GOLAY_BITS = 23
GOLAY_POLYNOMIAL = 0b101011100011
#: Groups at an anchor up to this size are compared at all lags at once, larger ones by a shrinking search.
LAGS = 48


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer: a bit is 1 if set in over half of the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, further columns to carry, and `fp`, the fingerprint as a long."""
    need(docs, "doc_id", "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(0).cast(pa.binary())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*batch.schema.names[1:], "fp"])

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *carry)
    return rows.mapInArrow(lean(run), ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes[1:]) + ", fp long")


class Golay:
    """The perfect code of length 23, built from its generator polynomial."""

    def __init__(self) -> None:
        def rest(x: int) -> int:
            for i in range(GOLAY_BITS - 1, 10, -1):
                if x >> i & 1:
                    x ^= GOLAY_POLYNOMIAL << (i - 11)
            return x

        unit = [rest(1 << i) for i in range(GOLAY_BITS)]
        self.syndrome = [np.zeros(1 << n, np.uint32) for n in (12, 11)]
        for table, first in zip(self.syndrome, (0, 12)):
            for i in range(len(table).bit_length() - 1):
                table[1 << i : 2 << i] = table[: 1 << i] ^ np.uint32(unit[first + i])
        near: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for bits in combinations(range(GOLAY_BITS), weight):
                s = e = 0
                for i in bits:
                    s, e = s ^ unit[i], e | 1 << i
                near[s].append(e)
        self.counts = np.array([len(x) for x in near])
        self.offsets = np.r_[0, np.cumsum(self.counts)[:-1]]
        self.errors = np.array([e for x in near for e in x], np.uint32)  # the first of each is its coset's leader

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        return self.syndrome[0][x & np.uint32(0xFFF)] ^ self.syndrome[1][x >> np.uint32(12)]


_golay: list[Golay] = []


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for all anchors that each of the fingerprints goes to."""
    if not _golay:
        _golay.append(Golay())
    code, rows, out = _golay[0], [], []
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        inner, outer = word & np.uint32(0x7FFFFF), (word >> np.uint32(GOLAY_BITS)).astype(np.int64)
        s = code.syndromes(inner)
        n = code.counts[s]
        i = np.repeat(np.arange(len(fp)), n)
        k = np.repeat(code.offsets[s] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(len(i))
        rows.append(i)
        out.append((half << 40) | outer[i] << GOLAY_BITS | (inner[i] ^ code.errors[k]).astype(np.int64))
        home = (inner ^ code.errors[code.offsets[s]]).astype(np.int64)
        for bit in range(9):
            i = np.flatnonzero(outer >> bit & 1)
            rows.append(i)
            out.append((half << 40) | (outer[i] ^ 1 << bit) << GOLAY_BITS | home[i])
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        i, anchor = anchors(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i])], names=["anchor", "fp"])


class Forest:
    """Keeps the links that join two parts; others say nothing new about components."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def joins(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[x] = y
        return True


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= THRESHOLD


def _search(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Tree edges of the components of a large group: each reached fingerprint is compared with those not yet reached."""
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(left, x)
            if hit.any():
                found, left = left[hit], left[~hit]
                queue += list(found)
                yield from ((int(x), int(y)) for y in found)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def compare(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        edges: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
        sizes = np.diff(cuts)
        for i in np.flatnonzero(sizes > LAGS):
            edges += [e for e in _search(fp[cuts[i] : cuts[i + 1]]) if forest.joins(*e)]
        few = np.repeat(sizes <= LAGS, sizes)
        anchor, fp = anchor[few], fp[few]
        at = np.arange(len(fp))
        for lag in range(1, LAGS):
            at = at[at + lag < len(fp)]
            at = at[anchor[at] == anchor[at + lag]]
            if not len(at):
                break
            hit = at[near(fp[at], fp[at + lag])]
            edges += [e for e in zip(fp[hit].tolist(), fp[hit + lag].tolist()) if forest.joins(*e)]
        if edges:
            u, v = (np.array(x, np.uint64).view(np.int64) for x in zip(*edges))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        return None

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        rows += batch.num_rows
        if rows < 500_000:
            continue
        anchor, fp = (np.concatenate(x) for x in zip(*held))
        whole = np.searchsorted(anchor, anchor[-1])  # the last anchor may go on in the next batch
        if whole and (got := compare(anchor[:whole], fp[:whole])) is not None:
            yield got
        held, rows = [(anchor[whole:], fp[whole:])], len(anchor) - whole
    if rows:
        anchor, fp = (np.concatenate(x) for x in zip(*held))
        if (got := compare(anchor, fp)) is not None:
            yield got


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(u, v) of distinct fingerprints `fp`: links whose components are those of all links at the threshold."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = fps.select("fp").mapInArrow(lean(_replicate), "anchor long, fp long")
    return copies.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(_links), "u long, v long")


def fingerprint_components(rows: DataFrame, bound: int | None = None) -> DataFrame:
    """(fp, root, component_id) for each distinct `fp` of rows with doc_id and fp; root is the fingerprint that names the component."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), 8)
    nodes = components(cut(fingerprint_links(distinct).distinct(), 8), bound)
    linked = cut(distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", "root"), 8)
    groups = linked.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.where("root is not null").join(groups, "root").select("fp", "root", "component_id")
    return joined.unionAll(linked.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")))


def near_duplicates(docs: DataFrame, *carry: str, bound: int | None = None) -> DataFrame:
    """doc_id, carried columns, fp, root and component_id (smallest doc_id that links reach) for every row."""
    rows = cut(fingerprints(docs, *carry))
    return lookup(rows, cut(fingerprint_components(rows, bound), 8), ["fp"], "left", bound)


def digest(docs: DataFrame, bound: int | None = None) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_duplicates(docs, bound=bound).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, bound: int | None = None) -> DataFrame:
    """One document of each group of near copies: the row with the smallest doc_id, of equal rows one."""
    key = list(KEY)
    found = near_duplicates(packed(docs).drop("__row"), *key, bound=bound)
    first = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), *key)).alias("first"))
    chosen = cut(first.select(*(F.col(f"first.{k}").alias(k) for k in key)), 8)
    kept = lookup(packed(docs), chosen, key, "left_semi", bound)
    # Of rows that are equal in doc_id and text, only one stays.
    many = cut(found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").join(chosen, key, "left_semi").select(*key), 8)
    if many.isEmpty():
        return unpacked(kept, docs.columns)
    once = lookup(kept, many, key, "left_anti", bound)
    twice = lookup(kept, many, key, "left_semi", bound).dropDuplicates(key)
    return unpacked(once.unionByName(twice), docs.columns)
