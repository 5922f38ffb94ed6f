"""The registry of queries: a function of Tables to a DataFrame, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with DuckDB SQL for the same rows."""

    def put(make: Callable[[Tables], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = with_fixtures(sql)
        return make

    return put
