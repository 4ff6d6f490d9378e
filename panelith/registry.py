"""All registered panel queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries, store_queries

assert store_queries.Q is queries.Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: fn for name, (fn, _sql) in queries.Q.items()}
ORACLES: dict[str, str] = {name: sql for name, (_fn, sql) in queries.Q.items() if sql}
