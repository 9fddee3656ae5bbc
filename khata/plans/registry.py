"""Name -> (Spark query, DuckDB text) registry filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "lookup_queries",
    "rule_queries",
    "audit_queries",
    "screening_queries",
    "shape_queries",
    "catalog_queries",
    "retrieval_queries",
    "ingest_queries",
    "stream_queries",
]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked by the driver."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    import importlib

    for name in MODULES:
        importlib.import_module(f"khata.plans.{name}")
