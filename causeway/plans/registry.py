"""All queries of the reference's operators, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.plans import attribution_queries, audit_queries, learning_queries, predict_queries, robustness_queries, series_queries, source_queries, statistics_queries, text_queries  # noqa: F401
from causeway.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["zdev_topk_hit"](spark, sf_dir)
