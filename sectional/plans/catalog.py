"""Registered queries: one Spark DataFrame builder and (where SQL can express
it) one DuckDB oracle statement per key. Keys follow SURVEY §7.3.

Every query reads the driver tables (or data Spark derives from them) in
full: no id subsets, row caps or sampling. Column names and types are the
same on both sides so the driver's value hash can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query builder (and its oracle SQL) to the catalog."""

    def wrap(fn: QueryFn) -> QueryFn:
        # Re-registering (a module reloaded by a harness) replaces the entry.
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for mod in ("queries_text", "queries_vectors", "queries_model", "queries_recurrent", "queries_training"):
        importlib.import_module(f"sectional.plans.{mod}")
