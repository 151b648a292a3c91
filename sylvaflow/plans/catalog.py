"""Catalogue of queries: name, Spark plan and the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def s6(expression: str, name: str | None = None) -> str:
    """SQL twin of ``r6``; adding zero removes the sign of a negative zero."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0" + (f" AS {name}" if name else "")
