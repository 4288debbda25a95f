"""Registry of the subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

MODULES = (
    "sharding", "secrets", "simhash", "fingerprints", "url_filters", "warc", "quality", "packing", "toxicity", "mixing",
    "suffixes", "runs", "tries",
)


def query(key: str, sql: str | None = None):
    """Register a query function under ``key``, with its SQL if SQL can express it."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def load() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Import every operator module and the pipeline; return (queries, SQL)."""
    for name in MODULES:
        importlib.import_module(f"dropledger.llm.{name}")
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
    return dict(QUERIES), dict(ORACLE)
