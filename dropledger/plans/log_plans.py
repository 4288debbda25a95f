"""Event log and check history: append, filter, purge, latest and recent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.functions.text import jst_iso
from dropledger.operators.changelog import purge_predicate
from dropledger.operators.logs import append_log, latest_by, log_filter, purge_log, recent
from dropledger.plans.bindings import t
from dropledger.plans.registry import query
from dropledger.session import shared_scratch

# Fixed mapping: event type → check result.
RESULT_OF_EVENT = {"purchase": "new_found", "error": "error", "view": "no_update",
                   "signup": "no_update", "click": "skipped"}


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as event-log rows (id, ts text in JST, level, category, message)."""
    e = t(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"),
        jst_iso("ts").alias("ts"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("level"),
        F.get_json_object("props", "$.k").alias("category"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"))


_LOG_SQL = """WITH log AS (
  SELECT event_id AS id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS ts,
         CAST(ts AS DATE) AS day, event_type AS level, json_extract_string(props, '$.k') AS category,
         'user ' || CAST(user_id AS VARCHAR) AS message
  FROM events)
"""


@query("log_append", _LOG_SQL + "SELECT id, ts, level, category, message FROM log")
def log_append(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log table in two batches and read back, without the stamp of the append."""
    path = shared_scratch(spark, "log") + "/table"
    rows = event_log(spark, sf).drop("day")
    early = F.coalesce(F.col("id") % 2 == 0, F.lit(False))
    append_log(rows.filter(early), path, stamp_col="appended_at")
    append_log(rows.filter(~early), path, stamp_col="appended_at")
    return spark.read.parquet(path).select("id", "ts", "level", "category", "message")


# Fixed query parameters: level filter (no category filter) and row limit.
FILTER_LEVEL, FILTER_CATEGORY, FILTER_LIMIT = "click", None, 1000


@query("log_filter", _LOG_SQL + f"""
, top AS (SELECT id, day, level, category FROM log WHERE level = '{FILTER_LEVEL}'
          ORDER BY day DESC, id DESC LIMIT {FILTER_LIMIT})
SELECT *, row_number() OVER (ORDER BY day DESC, id DESC) AS pos FROM top""")
def log_filter_q(spark: SparkSession, sf: str) -> DataFrame:
    """Newest 1000 events of a level, ties on the day broken by id descending."""
    top = log_filter(event_log(spark, sf), level=FILTER_LEVEL, category=FILTER_CATEGORY,
                     order=[F.col("day").desc(), F.col("id").desc()], limit=FILTER_LIMIT)
    w = Window.orderBy(F.col("day").desc(), F.col("id").desc())  # over at most FILTER_LIMIT rows
    return top.select("id", "day", "level", "category").withColumn("pos", F.row_number().over(w))


# Fixed query parameter: retention cutoff, compared as ISO text.
PURGE_CUTOFF = "2024-01-15T00:00:00+09:00"


@query("log_purge", _LOG_SQL + f"""
SELECT count_if(ts < '{PURGE_CUTOFF}') AS purged, count_if(NOT (ts < '{PURGE_CUTOFF}') OR ts IS NULL) AS kept FROM log""")
def log_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Retention purge: number of rows removed and kept (text comparison of stamps)."""
    purged = purge_predicate("ts", PURGE_CUTOFF)
    return event_log(spark, sf).agg(F.count_if(purged).alias("purged"), F.count_if(~purged).alias("kept"))


@query("log_purge_rows", _LOG_SQL + f"""
SELECT id, ts, level, category, message FROM log WHERE NOT (ts < '{PURGE_CUTOFF}') OR ts IS NULL""")
def log_purge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The log's next version after a purge, read back."""
    dest = shared_scratch(spark, "log") + "/purged"
    return purge_log(event_log(spark, sf).drop("day"), dest, "ts", PURGE_CUTOFF)


def check_history(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    res = None
    for k, v in RESULT_OF_EVENT.items():
        res = F.when(F.col("event_type") == k, v) if res is None else res.when(F.col("event_type") == k, v)
    return e.select(F.col("event_id").alias("id"), jst_iso("ts").alias("checked_at"), res.alias("result"))


_CHECK_SQL = "WITH checks AS (SELECT event_id AS id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS checked_at, CASE " + \
    " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in RESULT_OF_EVENT.items()) + " END AS result FROM events)\n"


@query("last_check", _CHECK_SQL + "SELECT id, checked_at, result FROM checks ORDER BY id DESC LIMIT 1")
def last_check(spark: SparkSession, sf: str) -> DataFrame:
    """The latest check (max id) — a global ``max_by``, partial per partition."""
    return latest_by(check_history(spark, sf), "id", ["checked_at", "result"])


# Fixed query parameter: default length of the recent-checks list.
RECENT_LIMIT = 100


@query("recent_checks", _CHECK_SQL + f"""
, top AS (SELECT * FROM checks ORDER BY id DESC LIMIT {RECENT_LIMIT})
SELECT *, row_number() OVER (ORDER BY id DESC) AS pos FROM top""")
def recent_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The most recent checks by id (a top-k: TakeOrderedAndProject)."""
    top = recent(check_history(spark, sf), [F.col("id").desc()], RECENT_LIMIT)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("id").desc())))
