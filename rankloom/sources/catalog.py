"""Names of public models that are worth ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Model names.
BASE_MODELS = [
    "distilbert-base-cased",
    "typeform/distilroberta-base-v2",
    "bert-base-cased",
    "SpanBERT/spanbert-base-cased",
    "roberta-base",
    "google/electra-small-discriminator",
    "google/electra-base-discriminator",
    "microsoft/deberta-v3-base",
    "sentence-transformers/all-MiniLM-L12-v2",
    "sentence-transformers/all-mpnet-base-v2",
    "FacebookAI/xlm-roberta-base",
    "microsoft/mdeberta-v3-base",
    "german-nlp-group/electra-base-german-uncased",
    "Lianglab/PharmBERT-cased",
    "Twitter/twhin-bert-base",
    "dmis-lab/biobert-base-cased-v1.2",
    "KISTI-AI/scideberta",
]
LARGE_MODELS = [
    "bert-large-uncased",
    "roberta-large",
    "google/electra-large-discriminator",
    "microsoft/deberta-v3-large",
    "sentence-transformers/all-mpnet-base-v2",
    "FacebookAI/xlm-roberta-large",
    "microsoft/mdeberta-v3-base",
    "deepset/gelectra-large",
    "dmis-lab/biobert-large-cased-v1.1",
    "Twitter/twhin-bert-large",
    "KISTI-AI/scideberta",
]


def prepare_popular_models(model_size: str = "base") -> list[str]:
    """The large models for 'large', the base models for anything else."""
    return list(LARGE_MODELS if model_size == "large" else BASE_MODELS)


def model_table(spark: SparkSession, model_size: str = "base") -> DataFrame:
    """(seq, model)."""
    return spark.createDataFrame(list(enumerate(prepare_popular_models(model_size))), "seq long, model string")
