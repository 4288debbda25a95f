"""Append-only logs: append with a stamp, filtered listing, latest, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropledger.functions.text import now_jst_iso
from dropledger.operators.changelog import purge_predicate


def append_log(rows: DataFrame, path: str, stamp_col: str = "ts", fmt: str = "parquet") -> None:
    """Append rows stamped with the current JST time to a log table.

    The table is partitioned by the stamp's day so that a retention purge
    rewrites only the affected day partitions.
    """
    stamped = rows.withColumn(stamp_col, now_jst_iso()).withColumn("day", F.substring(stamp_col, 1, 10))
    stamped.write.mode("append").partitionBy("day").format(fmt).save(path)


def purge_log(log: DataFrame, dest: str, ts: str, cutoff, fmt: str = "parquet") -> DataFrame:
    """Write the rows that a purge keeps as the next version of the log, by day; return it read back.

    A new version beside the old one: readers of either see whole rows, and
    a job that fails midway loses nothing.
    """
    kept = log.filter(~purge_predicate(ts, cutoff))
    kept.withColumn("day", F.substring(ts, 1, 10)).write.partitionBy("day").format(fmt).save(dest)
    return log.sparkSession.read.format(fmt).load(dest).drop("day")


def log_filter(log: DataFrame, level: str | None = None, category: str | None = None,
               order: Sequence[Column] | None = None, limit: int = 1000) -> DataFrame:
    """Optional level and category filters, newest first, capped at ``limit``.

    The cap is the listing's own feature (a top-k report); Spark plans it as
    a per-partition top-k followed by a merge (TakeOrderedAndProject).
    """
    df = log
    if level:
        df = df.filter(F.col("level") == level)
    if category:
        df = df.filter(F.col("category") == category)
    order = list(order) if order else [F.col("ts").desc(), F.col("id").desc()]
    return df.orderBy(*order).limit(limit)


def latest_by(log: DataFrame, seq: str, cols: Sequence[str]) -> DataFrame:
    """The row with the greatest ``seq`` as one row (an aggregate, not a sort)."""
    s = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq)).alias("_r")
    return log.agg(F.max(seq).alias(seq), s).select(seq, *[F.col("_r")[c].alias(c) for c in cols])


def recent(log: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return log.orderBy(*order).limit(k)


# Retention choices (days) offered for the event log.
RETENTION_DAYS = (30, 90, 3650)


def retention_cutoff(days: int) -> Column:
    """JST ISO text of now − ``days``, comparable with the log's stamps."""
    then = F.timestamp_add("DAY", F.lit(-days), F.current_timestamp())
    return F.concat(F.date_format(F.convert_timezone(None, F.lit("Asia/Tokyo"), then), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.lit("+09:00"))
