"""Region master lookups, selection, code validation and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.operators.dims import apply_overrides, by_codes, checked_master, code_validity, select_targets, selection_summary
from dropledger.plans.bindings import TARGETS_SQL, sql_with, t, targets
from dropledger.plans.registry import query
from dropledger.session import shared_uri
from dropledger.sources.jsondocs import read_overrides, write_overrides


@query("region_lookup", sql_with(TARGETS_SQL) + """
SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY target_order) AS INTEGER) AS region_rank,
       CAST(count(*) OVER (PARTITION BY region) AS BIGINT) AS region_size
FROM targets""")
def region_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The master with each target's rank inside its region (``by_region`` order).

    The window partitions a bounded dimension (one row per region target).
    """
    w = Window.partitionBy("region").orderBy("target_order")
    return (targets(spark, sf)
            .withColumn("region_rank", F.row_number().over(w).cast("int"))
            .withColumn("region_size", F.count(F.lit(1)).over(Window.partitionBy("region")).cast("long")))


def by_code(master: DataFrame, code: str) -> DataFrame:
    """Target by code; an unknown code is an error (checked on the tiny result)."""
    hit = master.filter(F.col("code") == code)
    if hit.limit(1).count() == 0:
        raise KeyError(f"Unknown target code: {code}")
    return hit


def by_region(master: DataFrame, region: str) -> DataFrame:
    return master.filter(F.col("region") == region).orderBy("target_order")


# Fixed query parameter: a selection including one code the master lacks.
SELECTION = ["nation_3", "nation_7", "nation_99", "nation_24"]


@query("target_select", sql_with(TARGETS_SQL) + f"""
, sel AS (SELECT code, target_order FROM targets WHERE code IN ({', '.join(f"'{c}'" for c in SELECTION)}))
SELECT code, target_order,
       CASE WHEN (SELECT count(*) FROM sel) = (SELECT count(*) FROM targets)
            THEN '全 ' || CAST((SELECT count(*) FROM targets) AS VARCHAR) || ' 地域'
            ELSE CAST((SELECT count(*) FROM sel) AS VARCHAR) || ' / ' || CAST((SELECT count(*) FROM targets) AS VARCHAR) || ' 地域'
       END AS summary
FROM sel""")
def target_select(spark: SparkSession, sf: str) -> DataFrame:
    """Selected targets in master order with the selection summary label."""
    master = targets(spark, sf)
    sel = spark.createDataFrame([(c,) for c in SELECTION], "code string")
    chosen = select_targets(master, sel).select("code", "target_order")
    # Both counts are scalar subqueries over the bounded master, evaluated in the plan.
    n = chosen.select(F.count(F.lit(1))).scalar()
    total = master.select(F.count(F.lit(1))).scalar()
    return chosen.select("code", "target_order", selection_summary(n, total).alias("summary"))


@query("valid_codes", sql_with(TARGETS_SQL) + """
, codes AS (SELECT DISTINCT unnest(['nation_' || CAST(c_nationkey AS VARCHAR),
                                    'nation_' || CAST(c_nationkey + 20 AS VARCHAR)]) AS code FROM customer)
SELECT code, code IN (SELECT code FROM targets) AS is_valid FROM codes""")
def valid_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes named by customers checked against the master (kept vs. warned)."""
    c = t(spark, sf, "customer")
    codes = c.select(F.explode(F.array(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")),
        F.concat(F.lit("nation_"), (F.col("c_nationkey") + 20).cast("string")))).alias("code"))
    return code_validity(codes, targets(spark, sf))


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier")
    return s.select(F.concat(F.lit("nation_"), (F.col("s_nationkey") + 10).cast("string")).alias("code"),
                    F.concat(F.lower("s_name"), F.lit("_custom")).alias("filename_key"),
                    F.col("s_suppkey").alias("pos"))


@query("override_apply", sql_with(TARGETS_SQL) + """
, o AS (SELECT 'nation_' || CAST(s_nationkey + 10 AS VARCHAR) AS code,
               arg_max(lower(s_name) || '_custom', s_suppkey) AS okey
        FROM supplier GROUP BY 1)
SELECT t.code, display_name, folder_label, region, coalesce(okey, filename_key) AS filename_key,
       target_order, okey IS NOT NULL AS overridden
FROM targets t LEFT JOIN o ON t.code = o.code""")
def override_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-named filename keys override the master; last supplier per code wins."""
    return apply_overrides(targets(spark, sf), _overrides(spark, sf))


@query("master_roundtrip", sql_with(TARGETS_SQL) + """
, o AS (SELECT 'nation_' || CAST(s_nationkey + 10 AS VARCHAR) AS code, arg_max(lower(s_name) || '_custom', s_suppkey) AS okey
        FROM supplier GROUP BY 1)
, used AS (SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS code, count(*) AS n_customers FROM customer GROUP BY 1)
SELECT code, n_customers, display_name, folder_label, region, coalesce(okey, filename_key) AS filename_key, target_order
FROM used JOIN targets USING (code) LEFT JOIN o USING (code)""")
def master_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Overridden keys saved as a document and loaded over the master again; the rows of all customers' codes, each of which must be known."""
    master = checked_master(targets(spark, sf))
    where = shared_uri(spark, "overrides")
    write_overrides(apply_overrides(master, _overrides(spark, sf)), where)
    loaded = apply_overrides(master, read_overrides(spark, where)).drop("overridden")
    c = t(spark, sf, "customer")
    used = c.groupBy(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("code")).agg(
        F.count(F.lit(1)).alias("n_customers"))
    return by_codes(loaded, used)
