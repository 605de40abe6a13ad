"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding takes two exchanges, both of packed blocks (about `BLOCK_BYTES` of text each):

1. A block explodes its texts into pre-tokens with positions and keeps its distinct words once (partial
   aggregation: a word that fills the corpus leaves one entry a block).  The words go to the bucket of their
   hash, where each distinct word of the corpus is encoded once; the ids go back to the blocks that asked.
2. A block's positions, as numbers of its own word list, meet the ids of its words, are replaced by them and
   come out document by document in their order.

Texts are never shuffled and no word list is ever gathered: all of it is keyed by bucket or block, so memory
is bounded by a block or by a bucket's distinct words, whatever the input.  Both exchanges read the input
once each; a block carries the hash of its contents in its number, and if the two readings should differ
(an input that is not repeatable), the join fails loudly instead of mixing ids.

Decoding joins the ids with the token-byte table (as long as the vocabulary) and concatenates.

Cases: a null text counts as empty and has no ids; a text of any length is in one block; words longer than
any token are merged like others; equal rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, lean, need, partitions

BLOCK_BYTES = 8 << 20
WORDS, CODES, IDS = 0, 1, 2
PACKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
DDL = "bucket int, block long, kind int, a binary, b binary, c binary"


def _zip(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PACKED)], schema=PACKED)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens with their ids."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _blocks(kind: int, pattern: str, n_buckets: int, block_bytes: int):
    """Rows of a kind (WORDS or CODES) of the blocks of a partition."""
    find = None

    def finish(local: dict[str, int], ids: list, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        lengths = np.array([len(x) for x in codes], np.int64)
        known = np.array([i is not None for i in ids])
        docs = np.array([i or 0 for i in ids], np.int64)
        words = [w.encode("utf-8", "surrogatepass") for w in local]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        contents = xxhash.xxh3_64()
        for part in (every, lengths, docs, known, sizes):
            contents.update(part.tobytes())
        contents.update(b"".join(words))
        block = int(np.array(contents.intdigest(), np.uint64).view(np.int64))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        if kind == CODES:
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            yield _batch([(0, block, CODES, _zip(place[every]), _squeeze(lengths.tobytes()), _squeeze(docs.tobytes() + known.tobytes()))])
            return
        bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(bounds)):
            mine = [words[i] for i in order[bounds[b] : bounds[b + 1]]]
            rows.append((int(b), block, WORDS, _zip(np.fromiter(map(len, mine), np.uint32, len(mine))), _squeeze(b"".join(mine)), None))
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal find
        find = find or regex.compile(pattern).findall
        size, local, ids, codes = 0, {}, [], []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if size and size + len(text) > block_bytes:
                    yield from finish(local, ids, codes)
                    size, local, ids, codes = 0, {}, [], []
                words = find(text)
                number = local.setdefault
                codes.append(np.fromiter((number(w, len(local)) for w in words), np.uint32, len(words)))
                ids.append(i)
                size += len(text)
        if ids:
            yield from finish(local, ids, codes)

    return run


def _encode_words(ranks, pattern: str):
    """Each bucket encodes its distinct words once and answers each block in the order of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        bucket, seen = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, seen = row["bucket"], {}
                data, ends = _expand(row["b"]), np.cumsum(_unzip(row["a"])).tolist()
                found, at = [], 0
                for end in ends:
                    word, at = data[at:end], end
                    if (ids := seen.get(word)) is None:
                        seen[word] = ids = np.array(encode(word), "<u4").tobytes()
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                yield _batch([(bucket, row["block"], IDS, _zip(counts), _zip(np.frombuffer(b"".join(found), "<u4")), None)])

    return run


ENCODED_DDL = "doc_id long, n_tokens long, ids binary"
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by number, kind and bucket: the codes of a block, then the ids of its words."""

    def finish(blocks: list[dict], table: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not blocks:
            raise RuntimeError("a block of words has no documents: the input changed between two readings; write it first")
        for codes in blocks:
            yield from documents(codes, table)

    def documents(codes: dict, table: list[bytes]) -> Iterator[pa.RecordBatch]:
        every = _unzip(codes["a"])
        ends = np.cumsum(np.frombuffer(_expand(codes["b"]), np.int64))
        if len(every) and int(every.max()) != len(table) - 1:
            raise RuntimeError("a block lacks ids of its words: the input changed between two readings; write it first")
        where = _expand(codes["c"])
        docs, known = np.frombuffer(where[: 8 * len(ends)], np.int64), np.frombuffer(where[8 * len(ends) :], bool)
        out, weight, at, first = [], 0, 0, 0
        for n, end in enumerate(ends.tolist(), 1):
            out.append(b"".join([table[c] for c in every[at:end].tolist()]))
            at, weight = end, weight + len(out[-1])
            if weight > 4 << 20 or n == len(ends):
                sizes = pa.array([len(x) // 4 for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(docs[first:n], mask=~known[first:n]), sizes, pa.array(out, pa.binary())], schema=ENCODED)
                out, weight, first = [], 0, n

    # Blocks of equal contents share a number: each of them is assembled, with one answer of each bucket.
    block, last, codes, table = None, -1, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                if block is not None:
                    yield from finish(codes, table)
                block, last, codes, table = row["block"], -1, [], []
            if row["kind"] == CODES:
                codes.append(row)
            elif row["bucket"] != last:
                last = row["bucket"]
                ids = _unzip(row["b"]).astype("<u4").tobytes()
                ends = (np.cumsum(_unzip(row["a"])) * 4).tolist()
                table += [ids[i:j] for i, j in zip([0, *ends], ends)]
    if block is not None:
        yield from finish(codes, table)


def _blocks_with_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int) -> DataFrame:
    """Both exchanges: the positions of each block beside the ids of its words."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    n, parts = buckets(spark), partitions(spark)
    sent = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = rows.mapInArrow(lean(_blocks(WORDS, pattern, n, block_bytes)), DDL)
    ids = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_encode_words(sent, pattern)), DDL)
    codes = rows.mapInArrow(lean(_blocks(CODES, pattern, n, block_bytes)), DDL)
    return ids.unionAll(codes).repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row.

    The ranks, of the size of a vocabulary, are sent to the workers.
    """
    return _blocks_with_ids(docs, ranks, pattern, block_bytes).mapInArrow(lean(_assemble), ENCODED_DDL)


def _decoder(spark, ranks: dict[bytes, int]):
    """Appends `decoded`, the bytes of `ids` by the token-byte table, to Arrow batches."""
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                made = [None if (x := v.as_py()) is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for v in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The encoded rows with `decoded`, the bytes of their ids."""
    return encoded.mapInArrow(lean(_decoder(encoded.sparkSession, ranks)), ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes) + ", decoded binary")


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`decode(encode(docs))` with both last steps in one Python pass, which halves the workers at work."""
    decoder = _decoder(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoder(_assemble(batches))

    return _blocks_with_ids(docs, ranks, pattern, block_bytes).mapInArrow(lean(run), ENCODED_DDL + ", decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
