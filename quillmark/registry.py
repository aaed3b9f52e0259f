"""All queries of the analysis's operators by name, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import sources, stats, text

_ALL = {**text.QUERIES, **stats.QUERIES, **sources.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group tests of text features, with effect sizes and false-discovery control."""
    return stats.compare_groups_q(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
