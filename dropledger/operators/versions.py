"""Write path of the catalogue: changes are appended, a compaction writes the next version of the state.

A state version holds the latest row of each key, tombstones included, so
compacting is the same fold over (previous version ∪ new changes) and the
order in which batches of changes arrive doesn't matter.  Versions are whole
tables beside each other: a reader of one is never disturbed, and a
compaction that fails midway leaves no version behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_changes(rows: DataFrame, log_path: str, batch: int) -> None:
    """Append one batch of changes (upserts, deletes) to the change log; repeating a batch replaces it."""
    rows.write.mode("overwrite").parquet(f"{log_path}/batch={batch}")


def read_changes(spark: SparkSession, log_path: str, schema, after: int, upto: int) -> DataFrame:
    """Changes of the batches after ``after`` up to ``upto``."""
    rows = spark.read.schema(schema).option("basePath", log_path).parquet(log_path)
    return rows.filter((F.col("batch") > after) & (F.col("batch") <= upto)).drop("batch")


def read_version(spark: SparkSession, state_path: str, version: int, schema) -> DataFrame:
    """One version of the state; version 0 is empty."""
    if version == 0:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(f"{state_path}/version={version}")
    except AnalysisException as exc:
        raise FileNotFoundError(f"no version {version} at {state_path}") from exc


def compact(previous: DataFrame, changes: DataFrame, state_path: str, version: int, keys: Sequence[str],
            seq: Sequence[str]) -> DataFrame:
    """Write version ``version``: the latest row by ``seq`` of each key in ``previous`` and ``changes``; return it."""
    rows = previous.unionByName(changes)
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    out = latest.select(*[F.col(k) if k in keys else F.col("_r")[k].alias(k) for k in rows.columns])
    out.write.mode("overwrite").parquet(f"{state_path}/version={version}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{state_path}/version={version}")


def current(state: DataFrame, op: str = "op", delete_value: str = "d") -> DataFrame:
    """The state's rows that aren't deleted."""
    return state.filter(F.col(op).isNull() | (F.col(op) != delete_value)).drop(op)
