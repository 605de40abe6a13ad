"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is chosen here only in a local session that names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir() and (named := spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(named)
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
