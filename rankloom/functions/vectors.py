"""Functions of array<float|double> columns; all arithmetic is in double, all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(vec: Column | str) -> Column:
    return _col(vec).cast(DOUBLES)


def scaled(vec: Column | str, factor: Column) -> Column:
    return F.transform(as_double(vec), lambda x: x * factor)


def weighted_sum(weighted: Column) -> Column:
    """Element-wise sum of w * vec over an array<struct<w, vec>>."""
    first = F.transform(as_double(F.get(weighted, F.lit(0))["vec"]), lambda x: F.lit(0.0))
    return F.aggregate(weighted, first, lambda s, r: F.zip_with(s, as_double(r["vec"]), lambda a, b: a + b * r["w"]))
