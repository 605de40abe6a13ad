"""Rank encoders for a labelled dataset: prepare, encode, pool, score all models and layers in one plan, rank."""

from __future__ import annotations

import copy
import functools
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.estimators import ESTIMATORS
from ..operators.pooling import layer_mean
from ..operators.prepare import LABEL, Prepared, Preparer, Task
from ..operators.ranking import AGGREGATORS, Result, reduce_layers
from ..sources.embedder import Embedder
from ..sources.encoders import Encoder, resolve
from ..sources.store import kept

logger = logging.getLogger("rankloom")


def confirm(estimator: str, layer_aggregator: str) -> None:
    """Options that are not known fail before any job runs."""
    for option, given, known in (("estimator", estimator, ESTIMATORS), ("layer_aggregator", layer_aggregator, AGGREGATORS)):
        if given not in known:
            raise ValueError(f"{option}={given!r} is unknown; one of {sorted(known)} is needed")


class ModelRanker:
    """Ranks encoders for one dataset (a DataFrame, or a dictionary of splits)."""

    def __init__(self, dataset: DataFrame | dict[str, DataFrame], dataset_downsample: float | None = None, text_column: str | None = None, label_column: str | None = None, **kwargs) -> None:
        preparer = Preparer(dataset_downsample=dataset_downsample, text_column=text_column, label_column=label_column, **kwargs)
        self.prepared: Prepared = preparer(dataset)

    @property
    def task(self) -> Task:
        return self.prepared.task

    def units(self, encoder: Encoder, layer_aggregator: str = "layermean", sentence_pooling: str = "mean", subword_pooling: str = "mean", batch_size: int = 32) -> DataFrame:
        """(model, layer, unit_id, vec, label): pooled vectors of words or texts with their targets."""
        encoder = copy.copy(encoder)
        encoder.batch_size = batch_size
        by_word = self.task == Task.TOKEN_CLASSIFICATION
        if by_word and sentence_pooling not in ("mean", None):
            logger.warning("sentence pooling does not apply to token classification")
        embedder = Embedder(encoder, subword_pooling, None if by_word else sentence_pooling, "-1" if layer_aggregator == "lastlayer" else "all", layer_aggregator == "layermean")
        vectors = embedder.embed_table(self.prepared.data, self.prepared.text)
        targets = self.prepared.targets().withColumn(LABEL, F.col(LABEL).cast("double"))
        if by_word:
            # Words beyond the encoder's length have no vector and drop out with their labels.
            joined = vectors.join(targets.withColumnRenamed("word_pos", "word_id"), ["row_id", "word_id"])
            unit = F.xxhash64("row_id", "word_id")
        else:
            joined = vectors.join(targets, "row_id")
            unit = F.col("row_id")
        return joined.select("model", "layer", unit.alias("unit_id"), "vec", LABEL)

    def layer_scores(self, models: list[Encoder | str], estimator: str = "hscore", layer_aggregator: str = "layermean", sentence_pooling: str = "mean", subword_pooling: str = "mean", batch_size: int = 32) -> DataFrame:
        """(model, layer, estimator, score) of all models and layers.

        The pooled vectors are written once to the checkpoint folder, so that each model reads each text once,
        whatever passes an estimator takes.
        """
        confirm(estimator, layer_aggregator)
        if not models:
            raise ValueError("no models to rank")
        metric = ESTIMATORS[estimator](regression=self.task.is_regression)
        units = functools.reduce(DataFrame.unionByName, [self.units(m, layer_aggregator, sentence_pooling, subword_pooling, batch_size) for m in resolve(models)])
        return metric.score(kept(units))

    def run(self, models: list[Encoder | str], estimator: str = "hscore", layer_aggregator: str = "layermean", batch_size: int = 32, sentence_pooling: str = "mean", subword_pooling: str = "mean") -> Result:
        """Score and rank the models; one row for each model and layer comes to the driver."""
        scores = self.layer_scores(models, estimator, layer_aggregator, sentence_pooling, subword_pooling, batch_size)
        return self._result(scores, models, estimator, layer_aggregator)

    def runs(self, models: list[Encoder | str], layer_aggregators: list[str], estimator: str = "hscore", batch_size: int = 32, sentence_pooling: str = "mean", subword_pooling: str = "mean") -> list[Result]:
        """A result for each way to reduce layers.

        Models that give all layers of a token at once read each text once for all of them: pooling weighs all layers
        alike, so the mean over layers can be taken of the pooled vectors.  Others run once for each way.
        """
        for aggregator in layer_aggregators:
            confirm(estimator, aggregator)
        encoders = resolve(models)
        if not encoders or not all(m.wide for m in encoders):
            return [self.run(models, estimator, x, batch_size, sentence_pooling, subword_pooling) for x in layer_aggregators]
        metric = ESTIMATORS[estimator](regression=self.task.is_regression)
        units = kept(functools.reduce(DataFrame.unionByName, [self.units(m, "bestlayer", sentence_pooling, subword_pooling, batch_size) for m in encoders]))
        last = functools.reduce(lambda a, b: a | b, [(F.col("model") == m.name) & (F.col("layer") == m.n_layers - 1) for m in encoders])
        made = {"bestlayer": lambda: units, "lastlayer": lambda: units.where(last), "layermean": lambda: layer_mean(units, ["model", "unit_id", LABEL])}
        return [self._result(metric.score(made[x]()), models, estimator, x) for x in layer_aggregators]

    def _result(self, scores: DataFrame, models: list[Encoder | str], estimator: str, layer_aggregator: str) -> Result:
        rows = scores.collect()
        result = Result(estimator)
        small = self.prepared.data.sparkSession.createDataFrame(rows, scores.schema)
        reduced = {r["model"]: r["score"] for r in reduce_layers(small, layer_aggregator).collect()}
        for model in dict.fromkeys(m if isinstance(m, str) else m.name for m in models):
            if model in reduced:
                result.add_score(model, reduced[model])
                result.add_layerwise_scores(model, {r["layer"]: r["score"] for r in sorted(rows, key=lambda r: r["layer"]) if r["model"] == model})
        logger.info("%s", result)
        return result
