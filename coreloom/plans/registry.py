"""Queries by name, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import Frames, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(frames) under its name, with SQL over the tables and views in braces."""
    def add(f: Callable[[Frames], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = duck(sql)
        return f

    return add


from . import corpus_queries, interval_queries, model_queries, record_queries  # noqa: E402, F401  they register themselves
