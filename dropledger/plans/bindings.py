"""How the catalogue's entities bind to the driver's tables.

* target (region master)  ≙ nation ⋈ region
* publication (data month) ≙ month of ``o_orderdate``
* file                     ≙ orders keyed by (month, customer nation)
* change-log sequence      ≙ (``o_orderdate``, ``o_orderkey``)
* outcome                  ≙ ``o_orderstatus``: F succeeded, O skipped, P failed
* tag / assignment         ≙ ``p_brand`` / parts and suppliers carrying it
* check history, event log ≙ ``events``
* content                  ≙ ``documents.text``; pages ≙ ``pages.html``

Each helper has a SQL twin (a CTE text) used by the oracle queries, so the
Spark side and the DuckDB side derive the same relation from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.functions.calendar import month_key_of
from dropledger.session import read_table

# Mapping of order status to download outcome and catalogue state.
OUTCOME_OF_STATUS = {"F": "succeeded", "O": "skipped", "P": "failed"}
PUB_STATUS_OF_STATUS = {"F": "complete", "O": "partial", "P": "pending"}


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def _map(col, mapping: dict[str, str]):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr


def _sql_map(col: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {arms} END"


# --- targets -----------------------------------------------------------------

def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Region master: code, display_name, folder_label, region, filename_key, target_order.

    Region is a fixed five-row dimension, so it is broadcast by hint.
    """
    n = t(spark, sf, "nation")
    r = t(spark, sf, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.lower("n_name").alias("code"),
                    F.col("n_name").alias("display_name"),
                    F.col("n_name").alias("folder_label"),
                    F.col("r_name").alias("region"),
                    F.lower("n_name").alias("filename_key"),
                    (F.col("n_nationkey") + 1).alias("target_order")))


TARGETS_SQL = """targets AS (
  SELECT lower(n_name) AS code, n_name AS display_name, n_name AS folder_label,
         r_name AS region, lower(n_name) AS filename_key, n_nationkey + 1 AS target_order
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


# --- publications and files -------------------------------------------------

def publication_log(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert log of publications: one upsert per order, in (date, key) order."""
    o = t(spark, sf, "orders")
    return o.select(
        month_key_of("o_orderdate").alias("publish_ym"),
        F.year("o_orderdate").alias("data_year"),
        F.month("o_orderdate").alias("data_month"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publish_date"),
        _map(F.col("o_orderstatus"), PUB_STATUS_OF_STATUS).alias("status"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")).alias("detected_at"),
        F.col("o_orderkey"),
        F.col("o_orderdate"),
    )


PUBLOG_SQL = f"""publog AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR) AS publish_ym,
         CAST(year(o_orderdate) AS INTEGER) AS data_year, CAST(month(o_orderdate) AS INTEGER) AS data_month,
         strftime(o_orderdate, '%Y-%m-%d') AS publish_date,
         {_sql_map('o_orderstatus', PUB_STATUS_OF_STATUS)} AS status,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS detected_at,
         o_orderkey, o_orderdate
  FROM orders)"""


def file_log(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert log of file records keyed (publish_ym, target_code)."""
    o = t(spark, sf, "orders")
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    oc = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    ym = month_key_of("o_orderdate")
    return oc.select(
        ym.alias("publish_ym"),
        F.lower("n_name").alias("target_code"),
        F.col("n_name").alias("display_name"),
        F.concat(ym, F.lit("/"), F.col("n_name"), F.lit(".zip")).alias("file_path"),
        F.col("o_orderkey"),
        F.col("o_orderdate"),
        F.col("o_orderpriority"),
        _map(F.col("o_orderstatus"), OUTCOME_OF_STATUS).alias("outcome"),
        F.col("o_orderstatus"),
    )


FILELOG_SQL = f"""filelog AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR) AS publish_ym,
         lower(n_name) AS target_code, n_name AS display_name,
         CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR) || '/' || n_name || '.zip' AS file_path,
         o_orderkey, o_orderdate, o_orderpriority,
         {_sql_map('o_orderstatus', OUTCOME_OF_STATUS)} AS outcome, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def sql_with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
