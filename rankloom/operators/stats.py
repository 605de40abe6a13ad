"""Additive statistics of embedding tables, keyed by (model, layer).

Tables have (model, layer, unit_id, vec, label).  Each task sums in numpy over Arrow batches and emits one
partial a key (partial aggregation); partials meet in two levels, first those of `FAN_IN` neighbouring tasks,
and are summed as they stream by, so memory does not grow with the table.  Two passes: the first for the mean, the second centred on it, so nothing cancels.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 32
#: A task sends its sums on when they fill this much memory.
TASK_BYTES = 256 << 20
PARTIAL = "model string, layer int, part int, stats binary"
PARTIAL_SCHEMA = pa.schema([("model", pa.string()), ("layer", pa.int32()), ("part", pa.int32()), ("stats", pa.binary())])


class Sums(dict):
    """Named arrays that add up; classes are kept by label."""

    def add(self, name: str, value) -> None:
        self[name] = self[name] + value if name in self else value

    def merge(self, other: "Sums") -> None:
        for k, v in other.items():
            if k == "mean":
                self[k] = v
            else:
                self.add(k, v)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> "Sums":
        with np.load(io.BytesIO(data)) as got:
            return cls({k: got[k] for k in got.files})

    @property
    def classes(self) -> list[float]:
        return sorted(float(k[2:]) for k in self if k.startswith("n:"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of one model and layer differ in length")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def keyed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each (model, layer) within each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        frame = pa.Table.from_batches([batch])
        keys = frame.select(["model", "layer"]).to_pandas()
        for key, at in keys.groupby(["model", "layer"], sort=False).indices.items():
            part = frame if len(at) == len(keys) else frame.take(pa.array(at))
            yield (key[0], int(key[1])), part.combine_chunks().to_batches()[0]


def partials(df: DataFrame, add: Callable[[tuple[str, int], Sums, np.ndarray, np.ndarray], None]) -> DataFrame:
    """Partial sums of every task: `add` sees a key, its sums, the vectors and the labels (float64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple[str, int], Sums] = {}

        def flush():
            rows = [(m, layer, part, s.pack()) for (m, layer), s in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PARTIAL_SCHEMA)], schema=PARTIAL_SCHEMA)

        for key, rows in keyed_batches(batches):
            x = matrix(rows.column(rows.schema.get_field_index("vec")))
            y = rows.column(rows.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.float64)
            add(key, held.setdefault(key, Sums()), x, y)
            if len(held) * x.shape[1] ** 2 * 8 > TASK_BYTES:
                yield flush()
        if held:
            yield flush()

    return df.select("model", "layer", "vec", "label").mapInArrow(run, PARTIAL)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of consecutive rows of one group, one group at a time."""
    now, total = None, Sums()

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, total.pack()), PARTIAL_SCHEMA)], schema=PARTIAL_SCHEMA)

    for batch in batches:
        for i in range(batch.num_rows):
            key = tuple(batch.column(c)[i].as_py() for c in range(3))
            if key != now:
                if now is not None:
                    yield row()
                now, total = key, Sums()
            total.merge(Sums.unpack(batch.column(3)[i].as_py()))
    if now is not None:
        yield row()


def tree_sum(parts: DataFrame) -> DataFrame:
    """One row of sums for each (model, layer): neighbouring tasks' partials first, then those of all."""
    for group in ((F.col("part") / FAN_IN).cast("int"), F.lit(0)):
        parts = parts.withColumn("part", group).repartition("model", "layer", "part").sortWithinPartitions("model", "layer", "part").mapInArrow(_merge, PARTIAL)
    return parts


def means(df: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The mean vector of each (model, layer). One vector for each comes to the driver."""

    def add(key, sums, x, y):
        sums.add("n", np.array(len(x)))
        sums.add("sum", x.sum(0))

    rows = tree_sum(partials(df, add)).collect()
    got = {(r["model"], r["layer"]): Sums.unpack(r["stats"]) for r in rows}
    return {k: s["sum"] / s["n"] for k, s in got.items()}


def layer_stats(df: DataFrame, regression: bool = False) -> DataFrame:
    """(model, layer, part, stats): n, centred Gram matrix and fourth norms, and sums by class or with the target."""
    centre = df.sparkSession.sparkContext.broadcast(means(df))

    def add(key, sums, x, y):
        mean = centre.value[key]
        x = x - mean
        norms = np.einsum("ij,ij->i", x, x)
        sums.add("n", np.array(len(x)))
        sums.add("gram", x.T @ x)
        sums.add("norm4", np.array((norms**2).sum()))
        if regression:
            sums.add("y", np.array(y.sum()))
            sums.add("yy", np.array((y * y).sum()))
            sums.add("xy", x.T @ y)
        else:
            values, at = np.unique(y, return_inverse=True)
            for i, v in enumerate(values):
                mine = x[at == i]
                sums.add(f"n:{float(v)!r}", np.array(len(mine)))
                sums.add(f"s:{float(v)!r}", mine.sum(0))
        sums["mean"] = mean

    return tree_sum(partials(df, add))
