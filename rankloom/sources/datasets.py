"""Readers: a path, or a path for each split, of Parquet, JSON lines, CSV or text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "json", "csv", "text")


def read_dataset(spark: SparkSession, paths: str | dict[str, str], format: str = "parquet", **options) -> DataFrame | dict[str, DataFrame]:
    """The dataset at a path, or a dictionary of its splits."""
    if format not in FORMATS:
        raise ValueError(f"unknown format '{format}'; known are {', '.join(FORMATS)}")
    if isinstance(paths, dict):
        return {split: read_dataset(spark, path, format, **options) for split, path in paths.items()}
    if format == "csv":
        options = {"header": True, "inferSchema": True, "multiLine": True, "escape": '"'} | options
    df = spark.read.format(format).options(**options).load(paths)
    return df.withColumnRenamed("value", "text") if format == "text" else df
