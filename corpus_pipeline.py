"""A corpus pipeline over the table documents: each stage works on all rows that the one before it kept.

Filtering stages keep clean documents as they are.  Stages read and return the columns of documents; the last
one returns token ids.  Between stages rows are written as Parquet to the session's checkpoint folder.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe, common, decontaminate, quality, simhash, substring, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that occur elsewhere; n_chars follows the text."""
    return substring.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks_path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    ranks = bpe.load_ranks(tokens.model_bytes(spark, ranks_path))
    return bpe.digest(bpe.encode_decode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Fingerprints, components and byte-pair merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents.  A stage's table is removed as soon as the next one is written."""
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return rows
        rows.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if before:
            common.remove_folder(spark, before)
        before = f"{folder}/{i}-{name}"
    return docs
