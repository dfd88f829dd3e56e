"""Registry of queries over the views and of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.checks.views import SparkViews, duckdb_sql, shared_views

QUERIES: dict[str, Callable[[SparkViews], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Views only the oracles use, written against the shared ones.
ORACLE_VIEWS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views)`` under the name, with its oracle SQL when it has one."""

    def register(fn: Callable[[SparkViews], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that summation order does not show."""
    return df.select(
        *[
            (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if kind == "double" else F.col(n)
            for n, kind in df.dtypes
        ]
    )


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[SparkViews], DataFrame]):
        return lambda spark, folder: fn(shared_views(spark, folder))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    return {name: duckdb_sql(sql, ORACLE_VIEWS) for name, sql in ORACLES.items()}


def text_list(column: str | Column, separator: str = "; ") -> Column:
    return F.array_join(column, separator)
