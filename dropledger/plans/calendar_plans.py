"""Calendar queries: month keys, shifts, publication info, download plan, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.functions.calendar import (
    DATA_ROOT_URL,
    compact_publish_key,
    doc_url,
    month_key,
    parse_month_key,
    publication_date,
    publish_info_from_key,
    publish_info_from_today,
    shift_month,
    zip_url,
)
from dropledger.operators.changelog import fold_state
from dropledger.operators.dims import explode_dimension
from dropledger.operators.gaps import missing_months
from dropledger.plans.bindings import PUBLOG_SQL, TARGETS_SQL, publication_log, sql_with, t, targets
from dropledger.plans.registry import query

_KEY_RE = r"^(\d{4})_(\d{1,2})$"
_PARSE_SQL = f"""CASE WHEN regexp_matches(month_key, '{_KEY_RE}')
            AND TRY_CAST(regexp_extract(month_key, '{_KEY_RE}', 2) AS INTEGER) BETWEEN 1 AND 12
       THEN CAST(regexp_extract(month_key, '{_KEY_RE}', GROUP_NO) AS INTEGER) END"""


@query("month_parse", f"""
WITH k AS (
  SELECT DISTINCT unnest([
      CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR),
      CAST(year(o_orderdate) AS VARCHAR) || '_' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'),
      CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) + 6 AS VARCHAR),
      CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR)]) AS month_key
  FROM orders)
SELECT month_key, {_PARSE_SQL.replace("GROUP_NO", "1")} AS data_year, {_PARSE_SQL.replace("GROUP_NO", "2")} AS data_month FROM k""")
def month_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Parse candidate month keys (valid, padded, month out of range, bad form)."""
    o = t(spark, sf, "orders")
    y, m = F.year("o_orderdate").cast("string"), F.month("o_orderdate")
    keys = F.array(month_key(F.year("o_orderdate"), m),
                   F.concat(y, F.lit("_"), F.lpad(m.cast("string"), 2, "0")),
                   F.concat(y, F.lit("_"), (m + 6).cast("string")),
                   F.concat(y, F.lit("-"), m.cast("string")))
    k = o.select(F.explode(keys).alias("month_key")).distinct()
    p = parse_month_key("month_key")
    return k.select("month_key", p["year"].alias("data_year"), p["month"].alias("data_month"))


# Fixed query parameter: month deltas applied by the shift query.
SHIFT_DELTAS = [-2, 2, -13, 25]


@query("month_shift", f"""
WITH ym AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders),
d AS (SELECT y, m, unnest({SHIFT_DELTAS}) AS delta FROM ym)
SELECT y, m, CAST(delta AS INTEGER) AS delta,
       CAST((y * 12 + (m - 1) + delta) // 12 AS INTEGER) AS shifted_year,
       CAST((y * 12 + (m - 1) + delta) % 12 + 1 AS INTEGER) AS shifted_month
FROM d""")
def month_shift(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    ym = o.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    d = ym.withColumn("delta", F.explode(F.array(*[F.lit(x) for x in SHIFT_DELTAS])))
    s = shift_month("y", "m", F.col("delta"))
    return d.select("y", "m", "delta", s["year"].alias("shifted_year"), s["month"].alias("shifted_month"))


_BASE = DATA_ROOT_URL


@query("publish_info", f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
i AS (SELECT d, CAST(year(d) AS INTEGER) AS py, CAST(month(d) AS INTEGER) AS pm,
             CAST(year(d - INTERVAL 2 MONTH) AS INTEGER) AS dy, CAST(month(d - INTERVAL 2 MONTH) AS INTEGER) AS dm
      FROM days)
SELECT strftime(d, '%Y-%m-%d') AS today, py AS publish_year, pm AS publish_month,
       dy AS data_year, dm AS data_month,
       CAST(dy AS VARCHAR) || '_' || CAST(dm AS VARCHAR) AS folder_name,
       CAST(py AS VARCHAR) || lpad(CAST(pm AS VARCHAR), 2, '0') || '010000' AS publish_ym_compact,
       '{_BASE}' || CAST(py AS VARCHAR) || lpad(CAST(pm AS VARCHAR), 2, '0') || '010000/' AS dir_url,
       '{_BASE}' || CAST(py AS VARCHAR) || lpad(CAST(pm AS VARCHAR), 2, '0') || '010000/typeB_danmen.pdf' AS doc_url,
       strftime(make_date(py, pm, 1), '%Y-%m-%d') AS publish_date,
       py AS from_key_publish_year, pm AS from_key_publish_month
FROM i""")
def publish_info(spark: SparkSession, sf: str) -> DataFrame:
    """Publication info of every order day taken as "today", and its inverse from the folder key."""
    days = t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    i = days.select("d", publish_info_from_today("d").alias("i"))
    back = publish_info_from_key(F.col("i.folder_name"))
    return i.select(
        F.date_format("d", "yyyy-MM-dd").alias("today"),
        F.col("i.publish_year"), F.col("i.publish_month"), F.col("i.data_year"), F.col("i.data_month"),
        F.col("i.folder_name"), F.col("i.publish_ym_compact"), F.col("i.dir_url"),
        doc_url(F.col("i.publish_ym_compact")).alias("doc_url"),
        publication_date("i.publish_year", "i.publish_month").alias("publish_date"),
        back["publish_year"].alias("from_key_publish_year"),
        back["publish_month"].alias("from_key_publish_month"))


@query("download_plan", sql_with(TARGETS_SQL) + f"""
, months AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS dy, CAST(month(o_orderdate) AS INTEGER) AS dm FROM orders),
p AS (SELECT dy, dm, CAST(year(make_date(dy, dm, 1) + INTERVAL 2 MONTH) AS INTEGER) AS py,
             CAST(month(make_date(dy, dm, 1) + INTERVAL 2 MONTH) AS INTEGER) AS pm FROM months)
SELECT CAST(dy AS VARCHAR) || '_' || CAST(dm AS VARCHAR) AS folder_name, code,
       '{_BASE}' || CAST(py AS VARCHAR) || lpad(CAST(pm AS VARCHAR), 2, '0') || '010000/typeB_' || filename_key || '.zip' AS url,
       folder_label || '.zip' AS dest_name
FROM p, targets""")
def download_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every data month × every target: the ZIP URL and its destination name."""
    months = (t(spark, sf, "orders")
              .select(F.year("o_orderdate").alias("dy"), F.month("o_orderdate").alias("dm")).distinct())
    plan = explode_dimension(months, targets(spark, sf).select("code", "filename_key", "folder_label"))
    info = publish_info_from_key(month_key("dy", "dm"))
    compact = compact_publish_key(info["publish_year"], info["publish_month"])
    return plan.select(info["folder_name"].alias("folder_name"), "code",
                       zip_url(compact, "filename_key").alias("url"),
                       F.concat("folder_label", F.lit(".zip")).alias("dest_name"))


def publications(spark: SparkSession, sf: str) -> DataFrame:
    """Publication state: last date/status per month, first detection kept."""
    return fold_state(publication_log(spark, sf), keys=["publish_ym"], seq=["o_orderdate", "o_orderkey"],
                      last=["publish_date", "status", "data_year", "data_month"],
                      first=["detected_at"])


PUBS_SQL = sql_with(PUBLOG_SQL, """pubs AS (
  SELECT publish_ym, arg_max(publish_date, (o_orderdate, o_orderkey)) AS publish_date,
         arg_max(status, (o_orderdate, o_orderkey)) AS status,
         arg_max(data_year, (o_orderdate, o_orderkey)) AS data_year,
         arg_max(data_month, (o_orderdate, o_orderkey)) AS data_month,
         arg_min(detected_at, (o_orderdate, o_orderkey)) AS detected_at
  FROM publog GROUP BY publish_ym)""")

# Fixed query parameters: the inclusive month range checked for gaps.
GAP_START, GAP_END = "1994_10", "2001_12"


@query("missing_months", PUBS_SQL + """
, spine AS (SELECT CAST(year(d) AS INTEGER) AS data_year, CAST(month(d) AS INTEGER) AS data_month
            FROM generate_series(DATE '1994-10-01', DATE '2001-12-01', INTERVAL 1 MONTH) g(d))
SELECT CAST(data_year AS VARCHAR) || '_' || CAST(data_month AS VARCHAR) AS publish_ym, data_year, data_month,
       row_number() OVER (ORDER BY data_year, data_month) AS pos
FROM spine s
WHERE NOT EXISTS (SELECT 1 FROM pubs p WHERE p.status = 'complete'
                  AND p.publish_ym = CAST(s.data_year AS VARCHAR) || '_' || CAST(s.data_month AS VARCHAR))""")
def missing_months_q(spark: SparkSession, sf: str) -> DataFrame:
    """Months in the range whose publication is not complete, in calendar order."""
    done = publications(spark, sf).filter(F.col("status") == "complete").select("publish_ym")
    gaps = missing_months(spark, GAP_START, GAP_END, done)
    w = Window.orderBy("data_year", "data_month")  # range is bounded by the parameters
    return gaps.withColumn("pos", F.row_number().over(w))
