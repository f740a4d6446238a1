"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import datasets, documents, graphs, retrieval, rules, search  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propagated retrieval of the whole query set, evaluated."""
    return QUERIES["retrieval_metrics_propagated"](spark, sf_dir)
