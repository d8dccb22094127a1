"""Every query of the core, by name, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import board, factor_queries, found, market_queries, measure_queries, search_queries, simulation_queries

_MODULES = (found, factor_queries, measure_queries, market_queries, simulation_queries, search_queries, board)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_queries.QUERIES["ic_flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
