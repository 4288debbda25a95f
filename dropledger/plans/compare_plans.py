"""Two ship months of ``lineitem``, compared by supplier and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.operators.compare import compare_months
from dropledger.plans.bindings import t
from dropledger.plans.registry import query

# Fixed query parameters: the two months, first days.
BEFORE, AFTER = "1995-03-01", "1995-04-01"


@query("month_compare", f"""
WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS supplier, l_returnflag AS flag,
                  CAST(l_quantity AS BIGINT) AS quantity, l_linestatus AS status,
                  CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem),
a0 AS (SELECT *, row_number() OVER (PARTITION BY supplier, flag, quantity, status) AS d FROM r WHERE month = DATE '{BEFORE}'),
b0 AS (SELECT *, row_number() OVER (PARTITION BY supplier, flag, quantity, status) AS d FROM r WHERE month = DATE '{AFTER}'),
f AS (SELECT coalesce(a0.supplier, b0.supplier) AS supplier, coalesce(a0.flag, b0.flag) AS flag,
             a0.quantity AS qa, a0.status AS sa, b0.quantity AS qb, b0.status AS sb, a0.d IS NOT NULL AS ia, b0.d IS NOT NULL AS ib
      FROM a0 FULL JOIN b0 ON a0.supplier IS NOT DISTINCT FROM b0.supplier AND a0.flag = b0.flag AND a0.quantity = b0.quantity
                          AND a0.status = b0.status AND a0.d = b0.d),
a1 AS (SELECT supplier, flag, qa, sa, row_number() OVER (PARTITION BY supplier, flag ORDER BY qa, sa) AS k FROM f WHERE ia AND NOT ib),
b1 AS (SELECT supplier, flag, qb, sb, row_number() OVER (PARTITION BY supplier, flag ORDER BY qb, sb) AS k FROM f WHERE ib AND NOT ia),
p AS (SELECT coalesce(a1.supplier, b1.supplier) AS supplier, coalesce(a1.flag, b1.flag) AS flag,
             CASE WHEN a1.k IS NULL THEN 'added' WHEN b1.k IS NULL THEN 'removed' ELSE 'changed' END AS change, qa, sa, qb, sb
      FROM a1 FULL JOIN b1 ON a1.supplier IS NOT DISTINCT FROM b1.supplier AND a1.flag = b1.flag AND a1.k = b1.k
      UNION ALL SELECT supplier, flag, 'same', qa, sa, qb, sb FROM f WHERE ia AND ib)
SELECT supplier, flag, change, qa AS quantity_before, sa AS status_before, qb AS quantity_after, sb AS status_after, count(*) AS n
FROM p GROUP BY ALL""")
def month_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Records of two ship months by (supplier, flag): same, changed, removed or added; line 7 has no supplier."""
    rows = t(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("supplier"), F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").cast("long").alias("quantity"), F.col("l_linestatus").alias("status"), "l_shipdate")

    def month(first: str) -> DataFrame:
        day = F.lit(first).cast("date")
        return rows.where((F.col("l_shipdate") >= day) & (F.col("l_shipdate") < F.add_months(day, 1)))

    out = compare_months(month(BEFORE), month(AFTER), ["supplier", "flag"], ["quantity", "status"])
    return out.select(
        "supplier", "flag", "change", F.col("before.quantity").alias("quantity_before"), F.col("before.status").alias("status_before"),
        F.col("after.quantity").alias("quantity_after"), F.col("after.status").alias("status_after"), "n")
