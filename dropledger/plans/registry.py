"""Registry of named queries over the driver's tables, each with its oracle SQL.

A plan module declares ``@query("key", sql=...)``; the entry module collects
them.  ``sql=None`` marks a query that has no SQL oracle (checked against a
brute-force reference in the unit tests instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that their queries register."""
    from dropledger.plans import (  # noqa: F401
        cache_plans,
        compare_plans,
        archive_plans,
        calendar_plans,
        catalog_plans,
        changelog_plans,
        dimension_plans,
        library_plans,
        log_plans,
        outcome_plans,
        stream_plans,
    )
