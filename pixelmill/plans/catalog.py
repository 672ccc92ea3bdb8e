"""Registry of the queries over the core operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelmill.plans import manifest_queries, model_queries, pixel_queries, region_queries

MODULES = (region_queries, manifest_queries, model_queries, pixel_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
