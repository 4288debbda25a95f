"""Batch twins of the event-time operators, over ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.functions.calendar import month_key
from dropledger.plans.bindings import sql_with, t
from dropledger.plans.calendar_plans import PUBS_SQL, publications
from dropledger.plans.library_plans import LISTING_SQL, listing
from dropledger.plans.registry import query
from dropledger.session import shared_uri
from dropledger.streaming.events import debounce, latest_progress, throttle
from dropledger.streaming.landing import change_log, landing_diff, refresh_changes

# Fixed query parameter: the debounce gap (events of a user closer than this form one burst).
GAP_SECONDS = 4 * 3600
_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"


@query("debounce_last", f"""
WITH e AS (SELECT user_id, ts, event_id, value,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > CAST({GAP_SECONDS} AS BIGINT) * 1000000 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, strftime(min(ts), '{_FMT_SQL}') AS session_start,
       strftime(max(ts) + INTERVAL {GAP_SECONDS} SECOND, '{_FMT_SQL}') AS session_end,
       arg_max(value, (ts, event_id)) AS last_value, count(*) AS n_events
FROM s GROUP BY user_id, sid""")
def debounce_last(spark: SparkSession, sf: str) -> DataFrame:
    """Per user, bursts of events closer than the gap collapse to their last value."""
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    d = debounce(e, "user_id", "ts", "value", GAP_SECONDS, tiebreak="event_id")
    return d.select("user_id", F.date_format("session_start", _FMT).alias("session_start"),
                    F.date_format("session_end", _FMT).alias("session_end"), "last_value", "n_events")


def _progress_records(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    return e.select(F.col("user_id").alias("target"), "ts", "event_id", F.col("event_type").alias("status"),
                    F.floor(F.col("value") * 10).cast("long").alias("bytes_done"),
                    F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1000)).cast("long")
                    .alias("bytes_total"))


@query("latest_progress", """
WITH r AS (SELECT user_id AS target, ts, event_id, event_type AS status, CAST(floor(value * 10) AS BIGINT) AS bytes_done,
                  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1000 END AS BIGINT) AS bytes_total FROM events),
l AS (SELECT target, arg_max(status, (ts, event_id)) AS status, arg_max(bytes_done, (ts, event_id)) AS bytes_done,
             arg_max(bytes_total, (ts, event_id)) AS bytes_total FROM r GROUP BY target)
SELECT *, CAST(least(100, floor(bytes_done * 100 / CASE WHEN bytes_total = 0 THEN 1 ELSE bytes_total END)) AS INTEGER) AS percent
FROM l""")
def latest_progress_q(spark: SparkSession, sf: str) -> DataFrame:
    """Latest progress record per target and its bar percentage."""
    r = _progress_records(spark, sf)
    return latest_progress(r, "target", F.struct("ts", "event_id"), ["status", "bytes_done", "bytes_total"])


@query("throttle_decision", PUBS_SQL + f"""
, r AS (SELECT event_id, user_id, ts, event_type,
               CAST(year(ts - INTERVAL 2 MONTH) AS VARCHAR) || '_' || CAST(month(ts - INTERVAL 2 MONTH) AS VARCHAR) AS folder,
               lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
d AS (SELECT r.*, prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) < CAST(86400 AS BIGINT) * 1000000 AS within,
             folder IN (SELECT publish_ym FROM pubs WHERE status = 'complete') AS done FROM r)
SELECT event_id, user_id,
       event_type = 'purchase' OR (event_type <> 'error' AND event_type <> 'signup' AND NOT within AND NOT done) AS run,
       CASE WHEN event_type = 'purchase' THEN 'manual or forced check'
            WHEN event_type = 'error' THEN 'auto_check_on_startup is disabled'
            WHEN event_type = 'signup' THEN 'save_root not configured'
            WHEN within THEN 'within recheck interval'
            WHEN done THEN 'publication ' || folder || ' already complete'
            ELSE 'publication ' || folder || ' incomplete or missing' END AS reason
FROM d""")
def throttle_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Recheck decision per request: purchase = forced, error = auto check off,
    signup = no library root; the 24 h interval counts from the user's previous request."""
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    shifted = F.add_months(F.to_date("ts"), -2)
    complete = publications(spark, sf).filter(F.col("status") == "complete").select(F.col("publish_ym").alias("folder"))
    out = throttle(e, "user_id", "ts", "event_id",
                   forced=F.col("event_type") == "purchase", auto_enabled=F.col("event_type") != "error",
                   has_root=F.col("event_type") != "signup", folder=month_key(F.year(shifted), F.month(shifted)),
                   complete_folders=complete)
    return out.select("event_id", "user_id", "run", "reason")


@query("landing_increment", sql_with(LISTING_SQL) + """
, state AS (SELECT path, length + toxic AS length, mtime FROM listing JOIN labels USING (doc_id))
SELECT l.path, l.length, l.mtime,
       CASE WHEN s.path IS NULL THEN 'new' WHEN l.length <> s.length OR l.mtime <> s.mtime THEN 'changed'
            ELSE 'unchanged' END AS change
FROM listing l LEFT JOIN state s ON l.path = s.path""")
def landing_increment(spark: SparkSession, sf: str) -> DataFrame:
    """Landing refresh: files diffed against the last scan's state by (size, mtime)."""
    li = listing(spark, sf)
    lab = t(spark, sf, "labels").select("doc_id", "toxic")
    state = li.join(lab, "doc_id").select("path", (F.col("length") + F.col("toxic")).alias("length"), "mtime")
    return landing_diff(li.select("path", "length", "mtime"), state)




@query("landing_changes", sql_with(LISTING_SQL) + """
, before AS (
  SELECT CASE WHEN toxic = 1 THEN replace(path, '/doc_', '/old_') ELSE path END AS path, length, mtime - quality AS mtime
  FROM listing JOIN labels USING (doc_id))
SELECT 1 AS v, path, length, mtime, 'new' AS change FROM before
UNION ALL
SELECT 2, coalesce(l.path, b.path), coalesce(l.length, b.length), coalesce(l.mtime, b.mtime),
       CASE WHEN b.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'deleted' ELSE 'changed' END
FROM listing l FULL JOIN before b ON l.path = b.path
WHERE b.path IS NULL OR l.path IS NULL OR l.length <> b.length OR l.mtime <> b.mtime""")
def landing_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The change log after two refreshes of a landing folder: files new, changed and deleted, by refresh."""
    now = listing(spark, sf).select("doc_id", "path", "length", "mtime")
    before = now.join(t(spark, sf, "labels"), "doc_id").select(
        F.when(F.col("toxic") == 1, F.regexp_replace("path", "/doc_", "/old_")).otherwise(F.col("path")).alias("path"),
        "length", (F.col("mtime") - F.col("quality")).alias("mtime"))
    log = shared_uri(spark, "landing-log")
    for version, files in ((1, before), (2, now), (2, before)):  # a refresh repeated by mistake adds nothing
        refresh_changes(files, log, version)
    return change_log(spark, log).select(F.col("v").cast("int").alias("v"), "path", "length", "mtime", "change")
