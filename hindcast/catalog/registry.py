"""Registry of queries: a Spark callable and, where SQL can say it, a SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hindcast.sources.binding import DriverTables

QueryFn = Callable[[DriverTables], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: QueryFn) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(DriverTables(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}
