"""Embeddings of texts: an encoder with its layer selection and pooling."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pooling
from .encoders import Encoder

logger = logging.getLogger("rankloom")


@dataclass
class Embedder:
    """Words or texts as vectors.

    `layer_ids` is 'all' or a comma list, negative numbers count from the last layer; `layer_mean` averages the
    selected layers into layer 0; `sentence_pooling` None keeps words.
    """

    encoder: Encoder
    subword_pooling: str = "mean"
    sentence_pooling: str | None = None
    layer_ids: str = "all"
    layer_mean: bool = False

    def __post_init__(self) -> None:
        self.layers = pooling.parse_layers(self.layer_ids, self.encoder.n_layers)

    def embed_table(self, texts: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
        """(model, row_id, layer[, word_id], vec) of a table of texts or token lists."""
        wide = self.encoder.wide
        tokens = self.encoder.encode(texts, text, self.layers, row_id, **({"wide": True} if wide else {}))
        return pooling.pool(tokens, self.subword_pooling, self.sentence_pooling, self.layer_mean, self.encoder.gathered, self.layers if wide else None)

    def embed(self, spark: SparkSession, sentences: str | list[str] | list[list[str]]) -> DataFrame:
        """The same for texts at hand: one text, several texts, or several token lists; row_id is the place in the list."""
        sentences = [sentences] if isinstance(sentences, str) else sentences
        if not any(sentences):
            logger.warning("all texts are empty")
        kind = "string" if not sentences or isinstance(sentences[0], str) else "array<string>"
        return self.embed_table(spark.createDataFrame(list(enumerate(sentences)), f"row_id long, text {kind}").where(F.col("text").isNotNull()))
