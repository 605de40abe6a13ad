"""Shared pieces of the training-data operators.

Row identity.  ``doc_id`` may be null or repeated, so operators that must bring a decision back to a row
key it by two 64-bit hashes of (doc_id, text), `KEY`.  Rows that agree on both are copies of one row and
always get the same decision.

Cutting lineage.  `cut` writes a frame to the reliable checkpoint folder of the session
(``spark.checkpoint.dir``), so that a lost executor loses nothing.  A folder is chosen here only where the
session names none and runs in one local process.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("__k1", "__k2")

#: Largest side, in bytes of its rows, that is sent to every executor.
BROADCAST_BYTES = 48 << 20

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir() and (named := spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(named)
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-ckpt-"))
    return context.getCheckpointDir()


#: Rows of a few numbers that one partition holds with ease.
PART_ROWS = 250_000


def cut(df: DataFrame, thin: int = 1) -> DataFrame:
    """The same rows, read back from the reliable checkpoint folder.

    `thin` divides the number of shuffle partitions, for tables much smaller than what they were made from; it
    merges the partitions of the last exchange, so the work before that keeps its parallelism.
    """
    shared_folder(df.sparkSession)
    if thin > 1:
        df = df.coalesce(partitions(df.sparkSession, thin))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession, thin: int = 1) -> int:
    """The number of shuffle partitions, divided by `thin`."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // thin)


def lean(run):
    """A function of Arrow batches that gives freed memory back to the system when a task ends.

    Python workers live on between tasks; without this each keeps what its largest task took.
    """

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def row_key(doc_id: Column, text: Column, *more: Column) -> list[Column]:
    """Two hashes that identify a row by its doc_id, its text and further columns; nulls count as values."""
    known = F.concat(*(F.isnull(c).cast("int") for c in (doc_id, text, *more)))
    return [F.xxhash64(doc_id, text, *more, known).alias(KEY[0]), F.xxhash64(F.lit(7), text, *more, known, doc_id).alias(KEY[1])]


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not among {df.columns}")


def row_bytes(schema: T.StructType) -> Column:
    """The bytes that a row holds, by its real strings and arrays, with room for its headers."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(value) + 16
        elif isinstance(kind, T.ArrayType):
            element = fixed(kind.elementType)
            size = F.size(value) * element + 32 if element else F.aggregate(value, F.lit(32).cast("long"), lambda a, x: a + of(x, kind.elementType).cast("long"))
        elif isinstance(kind, T.StructType):
            size = sum((of(value.getField(f.name), f.dataType) for f in kind), F.lit(16))
        else:
            size = F.lit(fixed(kind) or 64)
        return F.coalesce(size.cast("long"), F.lit(8).cast("long"))

    def fixed(kind: T.DataType) -> int:
        """Bytes of a value whose size does not depend on it, else 0."""
        if isinstance(kind, T.StructType):
            each = [fixed(f.dataType) for f in kind]
            return 16 + sum(each) if all(each) else 0
        return 0 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema), F.lit(48).cast("long"))


def small(df: DataFrame, bound: int | None = None) -> bool:
    """Whether the rows of a frame (already cut, so that reading it is cheap) are within the bound: their bytes are summed."""
    total = df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0
    return total <= (BROADCAST_BYTES if bound is None else bound)


def lookup(big: DataFrame, table: DataFrame, on: list[str], how: str = "left", bound: int | None = None) -> DataFrame:
    """Join a table with one row for each key to a large side.

    Within the bound (`BROADCAST_BYTES` unless given) the table is broadcast and the large side stays where it is.
    Beyond it both sides are shuffled by the key, and the adaptive skew join splits the keys that hold many rows of
    the large side.
    """
    if small(table, bound):
        table = F.broadcast(table)
    return big.join(table, on, how)


def input_bytes(df: DataFrame) -> int:
    """The size of the files and tables that a frame reads, as far as Spark knows it, for choosing how finely to split work."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets(spark: SparkSession, per_partition: int = 4, most_split: int = 4096) -> int:
    """How many buckets packed exchanges use: several for each shuffle partition, one where these are many already."""
    parts = partitions(spark)
    return max(8, parts, min(parts * per_partition, most_split))


def packed(docs: DataFrame) -> DataFrame:
    """Key, doc_id, text and the whole row as one struct, so that no other column can clash with working columns."""
    need(docs, "doc_id", "text")
    return docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("doc_id"), F.col("text"), F.struct("*").alias("__row"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of packed rows, in order, some of them changed."""
    return rows.select(*((changed[c] if c in changed else F.col("__row").getField(c)).alias(c) for c in columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of the frame."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
