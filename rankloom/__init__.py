"""Transferability scoring of representation models on Spark."""

from .operators.ranking import Result
from .plans.ranker import ModelRanker
from .sources.catalog import prepare_popular_models

__all__ = ["ModelRanker", "Result", "prepare_popular_models"]
