"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, the DuckDB oracle text.

"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: Optional[str] = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from jobsight.plans import queries_batch, queries_io, queries_rows, queries_stream  # noqa: F401
