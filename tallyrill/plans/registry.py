"""Where queries of tables and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import frame, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of tables under its name, with the SQL that gives its rows."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLE_SQL[f.__name__] = with_fixtures(sql)
        return f

    return add
