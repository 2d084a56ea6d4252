"""Query catalogue: every operator of the inventory as (Spark DataFrame query, independent DuckDB oracle SQL).

Each query takes (spark, sf_dir), reads the driver tables (or relations Spark derives from them) in full and returns
a lazy DataFrame. Computed columns carry the same alias in both engines; scores are rounded to 6 decimals; arrays are
space-joined where the oracle compares them as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` None marks a rows-only (non-SQL-expressible) operator."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from tidemark.plans import (q_core, q_reconcile, q_search, q_extract, q_quality, q_sources, q_store)  # noqa: F401
