"""Named queries over the test tables, with DuckDB SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); sql may use the fixture tables of fixtures.SQL."""

    def keep(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            from .fixtures import with_fixtures

            SQL[name] = with_fixtures(sql)
        return f

    return keep
