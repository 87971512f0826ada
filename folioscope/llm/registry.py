"""Queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECK_SQL[name] = sql
        return function

    return register


def all_queries() -> dict[str, Query]:
    from folioscope.llm import queries  # noqa: F401

    return dict(QUERIES)


def all_check_sql() -> dict[str, str]:
    all_queries()
    return dict(CHECK_SQL)
