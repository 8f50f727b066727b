"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans import answers, functions, ingestion, retrieval

_PLANS = (ingestion, functions, retrieval, answers)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["search_hybrid"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _PLANS for name, (f, _) in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, (_, sql) in plan.QUERIES.items() if sql}
