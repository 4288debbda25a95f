"""Month status, run summaries, failure predicates and content hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.operators.changelog import fold_state
from dropledger.operators.outcomes import (
    all_match,
    check_result,
    content_hash,
    newline_rows,
    outcome_counts,
    publication_status,
)
from dropledger.operators.reconcile import hash_reconcile
from dropledger.plans.bindings import (
    FILELOG_SQL,
    OUTCOME_OF_STATUS,
    _sql_map,
    file_log,
    sql_with,
    t,
    targets,
)
from dropledger.plans.registry import query

STATUS_SQL = """CASE WHEN {tc} <= 0 THEN 'pending'
            WHEN failed > 0 THEN 'partial'
            WHEN succeeded + skipped >= {tc} THEN 'complete'
            WHEN succeeded + skipped > 0 THEN 'partial'
            ELSE 'pending' END"""


def month_status(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: status of every publication month from its files' latest outcomes.

    Files fold to their last outcome per (month, target); the month's status
    follows the outcome-count chain against the size of the region master;
    months are listed newest first by numeric (year, month).
    """
    files = fold_state(file_log(spark, sf).withColumn("data_year", F.year("o_orderdate"))
                       .withColumn("data_month", F.month("o_orderdate")),
                       keys=["publish_ym", "target_code"], seq=["o_orderdate", "o_orderkey"],
                       last=["outcome", "data_year", "data_month"])
    # Scalar subquery over the bounded region master: evaluated inside the plan.
    target_count = targets(spark, sf).select(F.count(F.lit(1))).scalar()
    counts = outcome_counts(files, ["publish_ym", "data_year", "data_month"])
    return (counts
            .withColumn("target_count", target_count.cast("long"))
            .withColumn("status", publication_status("succeeded", "skipped", "failed", "target_count"))
            .orderBy(F.col("data_year").desc(), F.col("data_month").desc()))


MONTH_STATUS_SQL = sql_with(FILELOG_SQL, """files AS (
  SELECT publish_ym, arg_max(outcome, (o_orderdate, o_orderkey)) AS outcome,
         arg_max(CAST(year(o_orderdate) AS INTEGER), (o_orderdate, o_orderkey)) AS data_year,
         arg_max(CAST(month(o_orderdate) AS INTEGER), (o_orderdate, o_orderkey)) AS data_month
  FROM filelog GROUP BY publish_ym, target_code)""", """counts AS (
  SELECT publish_ym, data_year, data_month,
         count_if(outcome = 'succeeded') AS succeeded, count_if(outcome = 'skipped') AS skipped,
         count_if(outcome = 'failed') AS failed, (SELECT count(*) FROM nation) AS target_count
  FROM files GROUP BY ALL)""") + f"""
SELECT *, {STATUS_SQL.format(tc='target_count')} AS status FROM counts
ORDER BY data_year DESC, data_month DESC"""

query("month_status", MONTH_STATUS_SQL)(month_status)


def _year_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer × every order year: a generated spine (scalar subqueries
    for the year range, ``sequence`` + ``explode``), not a join."""
    o = t(spark, sf, "orders")
    y0 = o.select(F.min(F.year("o_orderdate"))).scalar()
    y1 = o.select(F.max(F.year("o_orderdate"))).scalar()
    return t(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.explode(F.sequence(y0, y1)).alias("yr"))


def _group_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    outcome = F.col("o_orderstatus")
    mapped = None
    for k, v in OUTCOME_OF_STATUS.items():
        mapped = F.when(outcome == k, v) if mapped is None else mapped.when(outcome == k, v)
    long = o.select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("yr"),
                    mapped.alias("outcome"))
    return outcome_counts(long, ["custkey", "yr"])


SPINE_SQL = f"""spine AS (
  SELECT c_custkey AS custkey, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS yr
  FROM customer, (SELECT min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders))""", \
    f"""grp AS (
  SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS yr,
         count_if({_sql_map('o_orderstatus', OUTCOME_OF_STATUS)} = 'succeeded') AS succeeded,
         count_if({_sql_map('o_orderstatus', OUTCOME_OF_STATUS)} = 'skipped') AS skipped,
         count_if({_sql_map('o_orderstatus', OUTCOME_OF_STATUS)} = 'failed') AS failed
  FROM orders GROUP BY ALL)"""


@query("pub_status", sql_with(*SPINE_SQL) + f"""
SELECT s.custkey, s.yr, coalesce(succeeded, 0) AS succeeded, coalesce(skipped, 0) AS skipped,
       coalesce(failed, 0) AS failed,
       {STATUS_SQL.format(tc='2').replace('failed', 'coalesce(failed, 0)').replace('succeeded + skipped', 'coalesce(succeeded, 0) + coalesce(skipped, 0)')} AS status
FROM spine s LEFT JOIN grp g ON s.custkey = g.custkey AND s.yr = g.yr""")
def pub_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status per (customer, year) with two targets per group; empty groups are pending."""
    g = _group_outcomes(spark, sf)
    out = _year_spine(spark, sf).join(g, ["custkey", "yr"], "left").na.fill(0, ["succeeded", "skipped", "failed"])
    return out.withColumn("status", publication_status("succeeded", "skipped", "failed", F.lit(2)))


@query("outcome_summary", sql_with(*SPINE_SQL) + """
SELECT s.custkey, s.yr, coalesce(succeeded, 0) AS new_count, coalesce(skipped, 0) AS skipped_count,
       coalesce(failed, 0) AS error_count,
       CASE WHEN g.custkey IS NULL THEN 'skipped' WHEN failed > 0 THEN 'error'
            WHEN succeeded > 0 THEN 'new_found' ELSE 'no_update' END AS result
FROM spine s LEFT JOIN grp g ON s.custkey = g.custkey AND s.yr = g.yr""")
def outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Check-run summary per (customer, year); a group without any outcome did not run."""
    g = _group_outcomes(spark, sf).withColumn("_ran", F.lit(True))
    out = _year_spine(spark, sf).join(g, ["custkey", "yr"], "left")
    ran = F.coalesce(F.col("_ran"), F.lit(False))
    return out.select(
        "custkey", "yr",
        F.coalesce("succeeded", F.lit(0)).alias("new_count"),
        F.coalesce("skipped", F.lit(0)).alias("skipped_count"),
        F.coalesce("failed", F.lit(0)).alias("error_count"),
        check_result("succeeded", "skipped", "failed", ran).alias("result"))


# Fixed marker texts used by the all-failures predicate query.
FAILURE_MARKERS = ['"k": 1', '"k": 2']


@query("all_match", f"""
SELECT user_id, CAST(ts AS DATE) AS day,
       count_if(event_type = 'error') > 0
       AND bool_and(event_type <> 'error' OR {' OR '.join(f"contains(props, '{m}')" for m in FAILURE_MARKERS)}) AS all_match
FROM events GROUP BY ALL""")
def all_match_q(spark: SparkSession, sf: str) -> DataFrame:
    """Per (user, day): the day's error messages are non-empty and all carry a marker."""
    e = t(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return all_match(e, ["user_id", "day"], "props", FAILURE_MARKERS,
                     member=F.col("event_type") == "error")


@query("content_hash", """
SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents""")
def content_hash_q(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.select("doc_id", content_hash("text").alias("sha256"),
                    F.octet_length("text").cast("long").alias("n_bytes"))


@query("newline_rows", """
SELECT doc_id, CAST(greatest(length(text) - length(replace(text, chr(10), '')) - 1, 0) AS BIGINT) AS data_rows
FROM documents""")
def newline_rows_q(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.select("doc_id", newline_rows("text").alias("data_rows"))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.filter(F.col("lang") != "de").select(
        F.col("doc_id").alias("target"), F.octet_length("text").cast("long").alias("size"), "text")


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    lab = t(spark, sf, "labels")
    # Hashed and measured where the text is read; only that is joined.
    d = t(spark, sf, "documents").select("doc_id", *[
        F.struct(content_hash(c).alias("sha256"), F.octet_length(c).cast("long").alias("size")).alias(name)
        for name, c in (("as_is", F.col("text")), ("upper", F.upper("text")))])
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("target"), F.when(F.col("quality") == 1, F.col("as_is")).otherwise(F.col("upper")).alias("r")
    ).select("target", "r.*")


@query("hash_reconcile", """
WITH landed AS (SELECT doc_id AS target, CAST(strlen(text) AS BIGINT) AS size, text FROM documents WHERE lang <> 'de'),
rec AS (SELECT l.doc_id AS target,
               sha256(CASE WHEN quality = 1 THEN text ELSE upper(text) END) AS sha256,
               CAST(strlen(CASE WHEN quality = 1 THEN text ELSE upper(text) END) AS BIGINT) AS size
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT d.doc_id AS target,
       CASE WHEN f.target IS NULL THEN 'missing'
            WHEN r.target IS NULL OR coalesce(r.sha256, '') = '' THEN 'new'
            WHEN r.size = f.size AND r.sha256 = sha256(f.text) THEN 'skip'
            ELSE 'changed' END AS action
FROM documents d LEFT JOIN rec r ON d.doc_id = r.target LEFT JOIN landed f ON d.doc_id = f.target""")
def hash_reconcile_q(spark: SparkSession, sf: str) -> DataFrame:
    """Skip a target only if its landed content hashes to the recorded hash."""
    tg = t(spark, sf, "documents").select(F.col("doc_id").alias("target"))
    return hash_reconcile(tg, _recorded(spark, sf), _landed(spark, sf), key="target")
