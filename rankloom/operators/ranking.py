"""Layer reduction, ranking, merging of runs, and the Result that users see."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AGGREGATORS = ("layermean", "lastlayer", "bestlayer")


def reduce_layers(scores: DataFrame, aggregator: str) -> DataFrame:
    """(model, score): the best layer's score, or the last layer's (the only one after a layer mean)."""
    usable = F.when(~F.isnan("score"), F.col("score"))
    made = F.max(usable) if aggregator == "bestlayer" else F.max_by("score", "layer")
    return scores.groupBy("model").agg(made.alias("score"))


def rank(scores: DataFrame) -> DataFrame:
    """(rank, seq, model, score): by score, highest first; earlier models first among equals; NaN and null last."""
    order = [F.when(~F.isnan("score"), F.col("score")).desc_nulls_last(), F.col("seq")]
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "seq", "model", "score")


def best_model(scores: DataFrame) -> DataFrame:
    """(model, score) of the highest score, the first of equals."""
    at = F.max_by(F.struct("model", "score"), F.struct(F.when(~F.isnan("score"), F.col("score")).alias("s"), (-F.col("seq")).alias("o")))
    return scores.agg(at.alias("b")).where("b is not null").select("b.model", "b.score")


def append_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merge two runs (seq, model, score): the right score wins, a known model keeps its place, new ones follow."""
    offset = left.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).cast("long").alias("offset"))
    b = right.select(F.col("seq").alias("seq_b"), F.col("model"), F.col("score").alias("score_b"), F.lit(True).alias("in_b")).join(F.broadcast(offset))
    both = left.join(b, "model", "full_outer")
    return both.select(F.coalesce("seq", F.col("seq_b") + F.col("offset")).cast("long").alias("seq"), "model", F.when(F.col("in_b"), F.col("score_b")).otherwise(F.col("score")).alias("score"))


@dataclass
class Result:
    """Scores of models under a metric, in the order in which they were added."""

    metric: str
    scores: dict[str, float] = field(default_factory=dict)
    layerwise_scores: dict[str, dict[int, float]] = field(default_factory=dict)

    def add_score(self, model: str, score: float) -> None:
        self.scores[model] = score

    def add_layerwise_scores(self, model: str, layer_scores: dict[int, float]) -> None:
        self.layerwise_scores[model] = layer_scores

    def append(self, other: Result) -> None:
        if self.metric != other.metric:
            raise ValueError(f"cannot append results of metric '{other.metric}' to results of '{self.metric}'")
        self.scores.update(other.scores)
        self.layerwise_scores.update(other.layerwise_scores)

    @property
    def ranked(self) -> list[tuple[str, float]]:
        return sorted(self.scores.items(), key=lambda x: (x[1] != x[1], -x[1] if x[1] == x[1] else 0.0))

    @property
    def best_model(self) -> str:
        return self.ranked[0][0] if self.scores else ""

    def __str__(self) -> str:
        if not self.scores:
            return "No scores available."
        return "\n".join(f"Rank {i}. {model}: {score:.4f}" for i, (model, score) in enumerate(self.ranked, 1))

    __repr__ = __str__
