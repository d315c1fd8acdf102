"""A tiny registry: query name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def sql_round(expr: str, digits: int) -> str:
    """DuckDB rounding that matches Spark's ``round`` (and Java's ``%f``): half-up on
    the shortest decimal form of the double, not on its binary value."""
    return (f"(CASE WHEN isnan({expr}) THEN ({expr}) ELSE CAST(round(CAST(CAST(({expr}) AS VARCHAR) "
            f"AS DECIMAL(38, 20)), {digits}) AS DOUBLE) END)")
