"""Catalogue mutations expressed as folds over change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.operators import versions
from dropledger.operators.changelog import (
    duplicate_keys,
    fold_state,
    insert_or_ignore,
    orphans,
    remove_matching,
    retract,
    toggle_parity,
)
from dropledger.operators.tags import cascade_fold, cascade_report
from dropledger.plans.bindings import FILELOG_SQL, file_log, sql_with, t
from dropledger.plans.calendar_plans import PUBS_SQL, publications
from dropledger.plans.registry import query
from dropledger.session import shared_scratch, written

_SEQ = ["o_orderdate", "o_orderkey"]
_SEQ_SQL = "(o_orderdate, o_orderkey)"


@query("upsert_keep_first", PUBS_SQL + "SELECT * FROM pubs")
def upsert_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Publication upserts: date and status replaced, first ``detected_at`` kept."""
    return publications(spark, sf)


@query("upsert_last", sql_with(FILELOG_SQL) + f"""
SELECT publish_ym, target_code,
       arg_max(display_name, {_SEQ_SQL}) AS display_name, arg_max(file_path, {_SEQ_SQL}) AS file_path,
       arg_max(o_orderkey, {_SEQ_SQL}) AS o_orderkey, arg_max(o_orderpriority, {_SEQ_SQL}) AS o_orderpriority,
       arg_max(outcome, {_SEQ_SQL}) AS outcome, count(*) AS versions
FROM filelog GROUP BY ALL""")
def upsert_last(spark: SparkSession, sf: str) -> DataFrame:
    """File upserts on (month, target): the latest row replaces every payload column."""
    return fold_state(file_log(spark, sf), keys=["publish_ym", "target_code"], seq=_SEQ,
                      last=["display_name", "file_path", "o_orderkey", "o_orderpriority", "outcome"],
                      versions="versions")


@query("state_compact", sql_with(FILELOG_SQL) + f"""
SELECT publish_ym, target_code, o_orderdate, o_orderkey, display_name, o_orderpriority FROM (
  SELECT publish_ym, target_code, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, {_SEQ_SQL}) AS o_orderkey,
         arg_max(display_name, {_SEQ_SQL}) AS display_name, arg_max(o_orderpriority, {_SEQ_SQL}) AS o_orderpriority,
         arg_max(o_orderstatus, {_SEQ_SQL}) AS st
  FROM filelog GROUP BY publish_ym, target_code)
WHERE st <> 'P'""")
def state_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of file changes (a failed download deletes), appended and compacted one after the other."""
    log = file_log(spark, sf).select(
        "publish_ym", "target_code", "o_orderdate", "o_orderkey", "display_name", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", F.lit("d")).otherwise(F.lit("u")).alias("op"))
    root = shared_scratch(spark, "catalogue")
    state = versions.read_version(spark, root + "/state", 0, log.schema)
    for batch in (1, 2, 3):  # batches arrive in any order of their rows
        part = F.pmod(F.col("o_orderkey"), F.lit(3)) == batch % 3
        versions.append_changes(log.filter(part), root + "/log", batch)
        changes = versions.read_changes(spark, root + "/log", log.schema, batch - 1, batch)
        state = versions.compact(state, changes, root + "/state", batch, ["publish_ym", "target_code"], _SEQ)
    return versions.current(state)


@query("delete_tombstone", sql_with(FILELOG_SQL) + f"""
, tomb AS (SELECT publish_ym, target_code, max({_SEQ_SQL}) AS lt FROM filelog WHERE o_orderstatus = 'P' GROUP BY ALL)
, life AS (SELECT f.* FROM filelog f LEFT JOIN tomb t USING (publish_ym, target_code)
           WHERE t.lt IS NULL OR (f.o_orderdate, f.o_orderkey) > t.lt)
SELECT publish_ym, target_code, arg_max(o_orderkey, {_SEQ_SQL}) AS o_orderkey,
       arg_max(o_orderpriority, {_SEQ_SQL}) AS o_orderpriority,
       arg_min(o_orderkey, {_SEQ_SQL}) AS first_orderkey, count(*) AS versions
FROM life GROUP BY ALL""")
def delete_tombstone(spark: SparkSession, sf: str) -> DataFrame:
    """Failed downloads delete the file record; a later upsert starts a new life."""
    log = written(file_log(spark, sf).select(  # joined once, read twice
        "publish_ym", "target_code", *_SEQ, "o_orderpriority", F.col("o_orderkey").alias("first_orderkey"),
        F.when(F.col("o_orderstatus") == "P", F.lit("d")).otherwise(F.lit("u")).alias("op")), "file-log")
    return fold_state(log, keys=["publish_ym", "target_code"], seq=_SEQ,
                      last=["o_orderkey", "o_orderpriority"], first=["first_orderkey"],
                      op="op", versions="versions")


def tag_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Assignment log: every line item assigns its part's brand to its supplier."""
    li = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    p = t(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("tag"), F.lit("file").alias("scope"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("scope_key"),
        "l_returnflag", "l_quantity")


ASSIGN_SQL = """assign AS (
  SELECT p_brand AS tag, 'file' AS scope, 'supplier_' || CAST(l_suppkey AS VARCHAR) AS scope_key, l_returnflag, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_TRIPLE = ["tag", "scope", "scope_key"]


@query("assign_distinct", sql_with(ASSIGN_SQL) + "SELECT DISTINCT tag, scope, scope_key FROM assign")
def assign_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Insert-or-ignore: repeated assignments collapse to one."""
    return insert_or_ignore(tag_assignments(spark, sf), _TRIPLE)


@query("unassign", sql_with(ASSIGN_SQL) + """
SELECT DISTINCT tag, scope, scope_key FROM assign a
WHERE NOT EXISTS (SELECT 1 FROM assign r WHERE r.l_returnflag = 'R' AND r.l_quantity >= 49 AND r.tag = a.tag
                  AND r.scope = a.scope AND r.scope_key = a.scope_key)""")
def unassign(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments hit by a large returned item are withdrawn (one pass over the log)."""
    return retract(tag_assignments(spark, sf), _TRIPLE, (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))


@query("toggle_parity", sql_with(ASSIGN_SQL) + """
SELECT tag, scope, scope_key, count(*) AS toggles FROM assign GROUP BY ALL HAVING count(*) % 2 = 1""")
def toggle_parity_q(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item toggles its (brand, supplier) tag; odd counts stay assigned."""
    return toggle_parity(tag_assignments(spark, sf).select(*_TRIPLE), _TRIPLE)


# Fixed query parameter: tags deleted in the cascade query.
DELETED_TAGS = ["Brand#1", "Brand#7", "Brand#13"]


@query("tag_cascade", f"""
SELECT p_brand AS tag, 'part' AS scope, 'part_' || CAST(p_partkey AS VARCHAR) AS scope_key FROM part
WHERE p_brand NOT IN ({', '.join(f"'{x}'" for x in DELETED_TAGS)})""")
def tag_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Deleting tags removes their assignments (anti join with the deleted set)."""
    p = t(spark, sf, "part")
    bridge = p.select(F.col("p_brand").alias("tag"), F.lit("part").alias("scope"),
                      F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("scope_key"))
    deleted = spark.createDataFrame([(x,) for x in DELETED_TAGS], "tag string")
    return remove_matching(bridge, deleted, ["tag"])


_CASCADE_SQL = sql_with(FILELOG_SQL) + """
, dset AS (SELECT DISTINCT publish_ym, target_code FROM filelog
           WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
, catalogue AS (SELECT DISTINCT publish_ym, target_code FROM filelog)
, bridge AS (SELECT DISTINCT o_orderpriority AS tag, publish_ym || '/' || target_code AS scope_key FROM filelog)
, manifest AS (SELECT DISTINCT publish_ym, target_code FROM filelog WHERE outcome = 'succeeded')
SELECT 'catalogue' AS store,
       count_if(d.publish_ym IS NOT NULL) AS removed, count_if(d.publish_ym IS NULL) AS remaining
FROM catalogue c LEFT JOIN dset d USING (publish_ym, target_code)
UNION ALL
SELECT 'tag_bridge', count_if(d.k IS NOT NULL), count_if(d.k IS NULL)
FROM bridge b LEFT JOIN (SELECT publish_ym || '/' || target_code AS k FROM dset) d ON b.scope_key = d.k
UNION ALL
SELECT 'manifest', count_if(d.publish_ym IS NOT NULL), count_if(d.publish_ym IS NULL)
FROM manifest m LEFT JOIN dset d USING (publish_ym, target_code)"""


_STORES = ["catalogue", "tag_bridge", "manifest"]


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of the three stores, marked if the delete set (failed urgent downloads) takes it."""
    return cascade_fold(
        file_log(spark, sf), ["publish_ym", "target_code"],
        doomed=(F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"),
        stores={"catalogue": (F.lit(True), None), "tag_bridge": (F.lit(True), F.col("o_orderpriority")),
                "manifest": (F.col("outcome") == "succeeded", None)})


@query("cascade_delete", _CASCADE_SQL)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """One delete set applied to catalogue, tag bridge and manifest; counts per store."""
    return cascade_report(_cascade(spark, sf), _STORES)


@query("cascade_survivors", sql_with(FILELOG_SQL) + """
, dset AS (SELECT DISTINCT publish_ym, target_code FROM filelog
           WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
, entries AS (
  SELECT DISTINCT 'catalogue' AS store, publish_ym, target_code, CAST(NULL AS VARCHAR) AS item FROM filelog
  UNION ALL SELECT DISTINCT 'tag_bridge', publish_ym, target_code, o_orderpriority FROM filelog
  UNION ALL SELECT DISTINCT 'manifest', publish_ym, target_code, NULL FROM filelog WHERE outcome = 'succeeded')
SELECT * FROM entries ANTI JOIN dset USING (publish_ym, target_code)""")
def cascade_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The three stores after the coordinated delete: every entry that is left, in one pass over the log."""
    return _cascade(spark, sf).where(~F.col("removed")).select("store", "publish_ym", "target_code", "item")


@query("unique_violations", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Tag names created more than once (each would raise in ``create_tag``)."""
    names = t(spark, sf, "part").select(F.col("p_name").alias("name"))
    return duplicate_keys(names, ["name"])


@query("fk_violations", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose order is missing from the (non-pending) orders: orphans."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    parents = t(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    return orphans(li, parents, ["l_orderkey"], ["o_orderkey"])
