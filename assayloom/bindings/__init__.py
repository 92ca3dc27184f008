"""The operators bound to the provided tables, each beside the SQL that must give the same rows.

``@query(name, sql)`` registers a function ``(spark, folder) -> DataFrame``. Without SQL the
result (a fitted model's output) has no SQL counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load() -> None:
    """Imports all binding modules, which register themselves."""
    from assayloom.bindings import (  # noqa: F401
        aggregates,
        flows,
        joins,
        modelling,
        projections,
        scans,
        splits,
        texts,
    )
