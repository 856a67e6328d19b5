"""The registry that query modules fill: a function of (spark, folder) and, where SQL says the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function over the named tables under its own name."""

    def wrap(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables])
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap
