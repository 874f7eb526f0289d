"""Names, plans and oracle SQL of every query outside the corpus subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofloom.plans import corpus_queries, dominance_queries, experiment_queries, guard_queries, history_queries, measure_queries, posting_queries, rule_queries, search_queries
from proofloom.plans.declare import ORACLES, QUERIES

__all__ = ["corpus_queries", "dominance_queries", "experiment_queries", "flagship", "guard_queries", "history_queries", "measure_queries", "oracle_sql", "posting_queries", "queries", "rule_queries", "search_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_queries.stemmed_top_alternatives(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
