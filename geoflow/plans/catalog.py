"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoflow.plans.domain import sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(statement: str | None = None, *names: str):
    """Register a query by its name, with its SQL over the named domain tables."""

    def add(f):
        _QUERIES[f.__name__] = f
        if statement:
            _SQL[f.__name__] = (sql(*names) if names else "") + statement
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
