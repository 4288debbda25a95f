"""Event-time operators: debounce, latest progress, recheck throttle.

Each has a batch form (used by the registered queries and checked against
SQL) and a Structured Streaming form over a ``readStream`` source; the unit
tests check that both give the same result under ``Trigger.AvailableNow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dropledger.operators.sequence import with_previous, with_session_id

# Decision reasons of the recheck throttle.
REASON_FORCED = "manual or forced check"
REASON_AUTO_OFF = "auto_check_on_startup is disabled"
REASON_NO_ROOT = "save_root not configured"
REASON_INTERVAL = "within recheck interval"
REASON_COMPLETE = "publication {} already complete"
REASON_INCOMPLETE = "publication {} incomplete or missing"
DEFAULT_INTERVAL_HOURS = 24


# --- debounce (last value of each burst) ------------------------------------------

def debounce(events: DataFrame, key: str, ts: str, value: str, gap_seconds: int,
             tiebreak: str | None = None) -> DataFrame:
    """Batch debounce: per key, bursts separated by more than the gap; emit the last value.

    Output: key, session_start, session_end (= last event + gap, as Spark's
    ``session_window``), last value, event count.
    """
    order = [ts] + ([tiebreak] if tiebreak else [])
    s = with_session_id(events, key, order, gap_seconds)
    seq = F.struct(*[F.col(c) for c in order])
    g = s.groupBy(key, "session_id").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("_last_ts"),
        F.max_by(F.col(value), seq).alias(f"last_{value}"), F.count(F.lit(1)).alias("n_events"))
    return g.select(key, "session_start",
                    F.timestamp_add("SECOND", F.lit(gap_seconds), F.col("_last_ts")).alias("session_end"),
                    f"last_{value}", "n_events")


def debounce_stream(events: DataFrame, key: str, ts: str, value: str, gap_seconds: int,
                    watermark: str = "1 day") -> DataFrame:
    """Streaming debounce with ``session_window``; a session is emitted once the
    watermark passes its end (append mode).  Late events are dropped.

    Watermarks need an instant type, so a ``timestamp_ntz`` event time is
    read as session-zone wall clock and the output converted back.
    """
    ntz = events.schema[ts].dataType.simpleString() == "timestamp_ntz"
    if ntz:
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    w = F.session_window(F.col(ts), f"{gap_seconds} seconds")
    out = (events.withWatermark(ts, watermark)
           .groupBy(F.col(key), w.alias("s"))
           .agg(F.max_by(F.col(value), F.col(ts)).alias(f"last_{value}"), F.count(F.lit(1)).alias("n_events")))
    back = (lambda c: c.cast("timestamp_ntz")) if ntz else (lambda c: c)
    return out.select(key, back(F.col("s.start")).alias("session_start"), back(F.col("s.end")).alias("session_end"),
                      f"last_{value}", "n_events")


# --- latest progress per target -------------------------------------------------------

def progress_percent(done: Column, total: Column) -> Column:
    """``min(100, floor(done * 100 / total))`` with a zero total treated as 1."""
    t = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(1)).otherwise(total)
    return F.least(F.lit(100), F.floor(done * 100 / t)).cast("int")


def latest_progress(records: DataFrame, key: str, seq: Column, cols: list[str]) -> DataFrame:
    """Last record per target (a partial-aggregated ``max_by``); works on a stream too
    (use update or complete output mode)."""
    last = records.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), seq).alias("_r"))
    out = last.select(key, *[F.col("_r")[c].alias(c) for c in cols])
    return out.withColumn("percent", progress_percent(F.col("bytes_done"), F.col("bytes_total")))


# --- recheck throttle -------------------------------------------------------------------

def _decide(p: DataFrame, ts: str, forced: Column, auto_enabled: Column, has_root: Column,
            complete_folders: DataFrame, interval_hours: int) -> DataFrame:
    """Decision columns from ``_prev`` (previous request time) and ``_folder``."""
    done = complete_folders.select(F.col("folder").alias("_folder")).distinct().withColumn("_done", F.lit(True))
    # Month folders are bounded by the calendar: broadcast them instead of shuffling the requests.
    p = p.join(F.broadcast(done), "_folder", "left")
    within = F.col("_prev").isNotNull() & (
        F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(ts)) < interval_hours * 3600 * 1_000_000)
    reason = (F.when(forced, F.lit(REASON_FORCED))
              .when(~auto_enabled, F.lit(REASON_AUTO_OFF))
              .when(~has_root, F.lit(REASON_NO_ROOT))
              .when(within, F.lit(REASON_INTERVAL))
              .when(F.col("_done").isNotNull(), F.format_string(REASON_COMPLETE.replace("{}", "%s"), F.col("_folder")))
              .otherwise(F.format_string(REASON_INCOMPLETE.replace("{}", "%s"), F.col("_folder"))))
    run = forced | (auto_enabled & has_root & ~within & F.col("_done").isNull())
    return p.withColumn("run", run).withColumn("reason", reason).drop("_prev", "_done", "_folder")


def throttle(requests: DataFrame, key: str, ts: str, tiebreak: str, forced: Column, auto_enabled: Column,
             has_root: Column, folder: Column, complete_folders: DataFrame,
             interval_hours: int = DEFAULT_INTERVAL_HOURS) -> DataFrame:
    """Batch throttle: every request stamps the clock (skipped ones too), so the
    interval is measured from the key's previous request.  Decision order:
    forced → run; auto off → no; no root → no; within interval → no;
    folder complete → no; else run."""
    p = with_previous(requests.withColumn("_folder", folder), key, [ts, tiebreak], "_before").withColumnRenamed("_before", "_prev")
    return _decide(p, ts, forced, auto_enabled, has_root, complete_folders, interval_hours)


def throttle_stream(requests: DataFrame, key: str, ts: str, tiebreak: str, forced: Column, auto_enabled: Column,
                    has_root: Column, folder: Column, complete_folders: DataFrame,
                    interval_hours: int = DEFAULT_INTERVAL_HOURS) -> DataFrame:
    """Streaming throttle: the per-key clock lives in state
    (:func:`throttle_stream_prev`); the decision is the batch expression,
    joined to the (static, bounded) set of complete month folders."""
    base = requests.withColumn("_folder", folder)
    schema = StructType(base.schema.fields + [StructField("_prev", base.schema[ts].dataType)])
    p = throttle_stream_prev(base, key, ts, tiebreak, schema)
    return _decide(p, ts, forced, auto_enabled, has_root, complete_folders, interval_hours)


def _throttle_state_fn(ts: str, tiebreak: str):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else None
        frames = [p for p in pdfs]
        if not frames:
            return
        df = pd.concat(frames).sort_values([ts, tiebreak])
        prevs = []
        for t in df[ts]:
            prevs.append(last)
            last = t
        df["_prev"] = prevs
        state.update((last,))
        yield df
    return fn


def throttle_stream_prev(requests: DataFrame, key: str, ts: str, tiebreak: str,
                         out_schema: str | StructType) -> DataFrame:
    """Streaming form of the throttle's clock: ``applyInPandasWithState`` keeps
    the last request time per key across micro-batches and adds ``_prev``;
    the decision itself is the same column expression as in :func:`throttle`."""
    return requests.groupBy(key).applyInPandasWithState(
        _throttle_state_fn(ts, tiebreak), outputStructType=out_schema,
        stateStructType=f"last {requests.schema[ts].dataType.simpleString()}",
        outputMode="append", timeoutConf="NoTimeout")


# --- streaming insert-or-ignore and log append ---------------------------------------------

def insert_or_ignore_stream(rows: DataFrame, keys: list[str], ts: str, watermark: str = "1 day") -> DataFrame:
    """Streaming insert-or-ignore: the first row of each key wins; keys are
    remembered until the watermark passes (``dropDuplicatesWithinWatermark``)."""
    if rows.schema[ts].dataType.simpleString() == "timestamp_ntz":
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def append_log_stream(rows: DataFrame, path: str, checkpoint: str, stamp_col: str = "ts"):
    """Append a stream of log rows, stamped with the JST time of their micro-batch,
    to a day-partitioned Parquet table (``availableNow``); returns the query."""
    from dropledger.functions.text import now_jst_iso
    stamped = rows.withColumn(stamp_col, now_jst_iso()).withColumn("day", F.substring(stamp_col, 1, 10))
    return (stamped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("day").outputMode("append").trigger(availableNow=True).start())
