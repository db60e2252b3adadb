"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with its DuckDB SQL where SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register
