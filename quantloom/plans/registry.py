"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dated: bool = True):
    """Registers a function of (spark, sf_dir) under ``name``, with its SQL. A column ``date`` is compared as text."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({sql})" if dated else sql
        return f

    return add


from quantloom.plans import forecasts, market, schemas, storage, tables, texts  # noqa: E402, F401
