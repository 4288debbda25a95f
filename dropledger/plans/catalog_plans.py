"""Keyed lookups, ordered listings, tags and labels over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.functions.text import export_name, file_label, format_bytes, month_label, scope_key, year_label
from dropledger.operators.changelog import fold_state
from dropledger.operators.gaps import month_spine
from dropledger.operators.tags import create_tags, keys_with_tag, tags_for
from dropledger.plans.bindings import FILELOG_SQL, file_log, sql_with, t
from dropledger.plans.calendar_plans import PUBS_SQL, publications
from dropledger.plans.registry import query

_SEQ = ["o_orderdate", "o_orderkey"]
_SEQ_SQL = "(o_orderdate, o_orderkey)"

# Fixed query parameters: the keys looked up.
LOOKUP_YM, LOOKUP_CODE = "1998_7", "nation_5"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """File records: latest row per (month, target)."""
    return fold_state(file_log(spark, sf), keys=["publish_ym", "target_code"], seq=_SEQ,
                      last=["display_name", "file_path", "o_orderkey", "outcome"])


FILES_SQL = sql_with(FILELOG_SQL) + f""", files AS (
  SELECT publish_ym, target_code, arg_max(display_name, {_SEQ_SQL}) AS display_name,
         arg_max(file_path, {_SEQ_SQL}) AS file_path, arg_max(o_orderkey, {_SEQ_SQL}) AS o_orderkey,
         arg_max(outcome, {_SEQ_SQL}) AS outcome
  FROM filelog GROUP BY ALL)
"""


@query("pub_lookup", PUBS_SQL + f"SELECT * FROM pubs WHERE publish_ym = '{LOOKUP_YM}'")
def pub_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Publication by key (the key filter is pushed below the fold's shuffle)."""
    return publications(spark, sf).filter(F.col("publish_ym") == LOOKUP_YM)


@query("pub_complete", PUBS_SQL + """
, spine AS (SELECT CAST(year(d) AS VARCHAR) || '_' || CAST(month(d) AS VARCHAR) AS publish_ym
            FROM generate_series(DATE '1994-10-01', DATE '2001-12-01', INTERVAL 1 MONTH) g(d))
SELECT s.publish_ym, coalesce(p.status = 'complete', false) AS is_complete
FROM spine s LEFT JOIN pubs p ON s.publish_ym = p.publish_ym""")
def pub_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Is-complete for every month of a range: a missing row is not complete."""
    spine = month_spine(spark, "1994_10", "2001_12").select("publish_ym")
    p = publications(spark, sf).select("publish_ym", "status")
    return spine.join(p, "publish_ym", "left").select(
        "publish_ym", F.coalesce(F.col("status") == "complete", F.lit(False)).alias("is_complete"))


@query("file_lookup", FILES_SQL + f"SELECT * FROM files WHERE publish_ym = '{LOOKUP_YM}' AND target_code = '{LOOKUP_CODE}'")
def file_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).filter((F.col("publish_ym") == LOOKUP_YM) & (F.col("target_code") == LOOKUP_CODE))


@query("files_by_month", FILES_SQL + f"""
SELECT *, row_number() OVER (ORDER BY target_code) AS pos FROM files WHERE publish_ym = '{LOOKUP_YM}'""")
def files_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one month by code; the window covers one month (≤ one row per target)."""
    f = files(spark, sf).filter(F.col("publish_ym") == LOOKUP_YM)
    return f.withColumn("pos", F.row_number().over(Window.orderBy("target_code"))).orderBy("pos")


@query("files_by_target", FILES_SQL + f"""
SELECT *, row_number() OVER (ORDER BY publish_ym DESC) AS pos FROM files WHERE target_code = '{LOOKUP_CODE}'""")
def files_by_target(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one target over months, newest first by the key *text*."""
    f = files(spark, sf).filter(F.col("target_code") == LOOKUP_CODE)
    return f.withColumn("pos", F.row_number().over(Window.orderBy(F.col("publish_ym").desc()))).orderBy("pos")


@query("pubs_ordered", PUBS_SQL + """
SELECT publish_ym, status, row_number() OVER (ORDER BY publish_ym DESC) AS pos FROM pubs""")
def pubs_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """All publications by key descending, lexicographic (``2001_10`` < ``2001_3``)."""
    p = publications(spark, sf).select("publish_ym", "status")
    return p.withColumn("pos", F.row_number().over(Window.orderBy(F.col("publish_ym").desc()))).orderBy("pos")


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tag dimension: one tag per brand, id = smallest part key of the brand."""
    p = t(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("tag_id"))


def type_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Bridge (tag_id, scope='type', scope_key=p_type), insert-or-ignore."""
    p = t(spark, sf, "part").select("p_brand", "p_type")
    tg = tags(spark, sf)
    return (p.join(tg, p.p_brand == tg.name)
            .select("tag_id", F.lit("type").alias("scope"), F.col("p_type").alias("scope_key")).distinct())


TAGS_SQL = """tags AS (SELECT p_brand AS name, min(p_partkey) AS tag_id FROM part GROUP BY p_brand),
bridge AS (SELECT DISTINCT tag_id, 'type' AS scope, p_type AS scope_key FROM part JOIN tags ON p_brand = name)"""


@query("tags_sorted", sql_with(TAGS_SQL) + "SELECT name, tag_id, row_number() OVER (ORDER BY name) AS pos FROM tags")
def tags_sorted(spark: SparkSession, sf: str) -> DataFrame:
    tg = tags(spark, sf)
    return tg.withColumn("pos", F.row_number().over(Window.orderBy("name"))).orderBy("pos")


@query("tag_create", sql_with(TAGS_SQL) + """
, fresh AS (SELECT p_name || ' / ' || p_type AS name, '#' || lpad(CAST(max(p_size) AS VARCHAR), 6, '0') AS color FROM part GROUP BY 1)
SELECT tag_id, name, CAST(NULL AS VARCHAR) AS color FROM tags
UNION ALL SELECT (SELECT max(tag_id) FROM tags) + row_number() OVER (ORDER BY name), name, color FROM fresh""")
def tag_create(spark: SparkSession, sf: str) -> DataFrame:
    """The tags after a batch of new ones, one for each pair of part name and type (names must be unique)."""
    old = tags(spark, sf).select("tag_id", "name", F.lit(None).cast("string").alias("color"))
    fresh = t(spark, sf, "part").groupBy(F.concat("p_name", F.lit(" / "), "p_type").alias("name")).agg(
        F.concat(F.lit("#"), F.lpad(F.max("p_size").cast("string"), 6, "0")).alias("color"))
    return create_tags(old, fresh)


# Fixed query parameters: the scope key and tag looked up.
SCOPE, SCOPE_KEY, TAG_NAME = "type", "ECONOMY", "Brand#3"


@query("tags_for_scope", sql_with(TAGS_SQL) + f"""
SELECT t.name, t.tag_id, row_number() OVER (ORDER BY t.name) AS pos
FROM tags t JOIN bridge b ON t.tag_id = b.tag_id WHERE b.scope = '{SCOPE}' AND b.scope_key = '{SCOPE_KEY}'""")
def tags_for_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of one scope key ordered by name (inner join; tags are broadcast-sized)."""
    r = tags_for(tags(spark, sf), type_assignments(spark, sf), SCOPE, SCOPE_KEY)
    return r.select("name", "tag_id").withColumn("pos", F.row_number().over(Window.orderBy("name")))


@query("scopes_with_tag", sql_with(TAGS_SQL) + f"""
SELECT scope_key FROM bridge WHERE scope = '{SCOPE}' AND tag_id = (SELECT tag_id FROM tags WHERE name = '{TAG_NAME}')""")
def scopes_with_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Scope keys carrying one tag (order unspecified, as in the reference)."""
    tg = tags(spark, sf).filter(F.col("name") == TAG_NAME)
    return keys_with_tag(type_assignments(spark, sf), tg, SCOPE)


@query("scope_key", """
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR) || '/'
       || coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE lower(n_name) END, ''),
                   'order_' || CAST(o_orderkey AS VARCHAR) || '.zip') AS scope_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def scope_key_q(spark: SparkSession, sf: str) -> DataFrame:
    """Scope key per order file: ``ym/code``, or ``ym/<file name>`` when the code is empty."""
    o = t(spark, sf, "orders")
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    code = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.lower("n_name"))
    ym = F.concat_ws("_", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"))
    fname = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".zip"))
    return j.select("o_orderkey", scope_key(ym, code, fname).alias("scope_key"))


def _bytes_sql(x: str) -> str:
    def ratio(d: int, p: int) -> str:
        return f"CAST(CAST(round_even(CAST({x} AS DECIMAL(20,0)) / CAST({d} AS DECIMAL(20,0)), {p}) AS DECIMAL(24,{p})) AS VARCHAR)"
    return (f"CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B' "
            f"WHEN {x} < 1048576 THEN {ratio(1024, 1)} || ' KB' "
            f"WHEN {x} < 1073741824 THEN {ratio(1048576, 1)} || ' MB' "
            f"ELSE {ratio(1073741824, 2)} || ' GB' END")


def _file_size(orderkey):
    """Synthetic byte size spanning B … GB: orderkey² × 97."""
    return orderkey.cast("long") * orderkey.cast("long") * F.lit(97)


@query("file_detail", FILES_SQL + f""", tagged AS (
  SELECT publish_ym || '/' || target_code AS scope_key, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS tags
  FROM filelog WHERE outcome <> 'failed' GROUP BY 1)
SELECT f.publish_ym, f.target_code, f.display_name,
       coalesce(nullif(f.target_code, 'nation_0'), '—') AS code_text,
       {_bytes_sql('CAST(f.o_orderkey AS BIGINT) * CAST(f.o_orderkey AS BIGINT) * 97')} AS size_text,
       coalesce(CASE WHEN f.outcome = 'failed' THEN NULL ELSE f.outcome END, '—') AS status_text,
       coalesce(g.tags, '—') AS tags
FROM files f LEFT JOIN tagged g ON g.scope_key = f.publish_ym || '/' || f.target_code""")
def file_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Detail record per file: NULLs shown as ``—``, sizes in units, tags joined by ``, ``.

    Latest row and tags come from one pass; a file's tags are few (one per
    priority), so collecting them per file is bounded.
    """
    f = fold_state(file_log(spark, sf), keys=["publish_ym", "target_code"], seq=_SEQ, last=["display_name", "o_orderkey", "outcome"],
                   also={"tags": F.sort_array(F.collect_set(F.when(F.col("outcome") != "failed", F.col("o_orderpriority"))))})
    dash = F.lit("—")
    return f.select(
        "publish_ym", "target_code", "display_name",
        F.coalesce(F.nullif(F.col("target_code"), F.lit("nation_0")), dash).alias("code_text"),
        format_bytes(_file_size(F.col("o_orderkey"))).alias("size_text"),
        F.coalesce(F.when(F.col("outcome") != "failed", F.col("outcome")), dash).alias("status_text"),
        F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise(dash).alias("tags"))


@query("scalar_labels", f"""
SELECT c_custkey,
       c_name || '  ' || coalesce(format('{{:,}}', CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey * 1237 AS BIGINT) END) || '行', '—行')
       || '  ' || CAST(CAST(round_even(CAST(CAST(c_custkey AS BIGINT) * 12345678 AS DECIMAL(20,0)) / CAST(1073741824 AS DECIMAL(20,0)), 2) AS DECIMAL(24,2)) AS VARCHAR) || 'GB' AS file_label,
       {_bytes_sql('CAST(c_custkey AS BIGINT) * CAST(c_custkey AS BIGINT) * 3001')} AS size_text,
       CAST(1990 + c_nationkey AS VARCHAR) || '年' AS year_label,
       CAST(1990 + c_nationkey AS VARCHAR) || '年' || CAST(c_custkey % 12 + 1 AS VARCHAR) || '月分 ('
         || CAST(1990 + c_nationkey AS VARCHAR) || '_' || CAST(c_custkey % 12 + 1 AS VARCHAR) || ')'
         || CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE ' [' || lower(c_mktsegment) || ']' END AS month_label,
       'export_' || CAST(1990 + c_nationkey AS VARCHAR) || '_' || CAST(c_custkey % 12 + 1 AS VARCHAR) || '_'
         || strftime(TIMESTAMP '2026-05-01 10:00:00' + INTERVAL (c_custkey) SECOND, '%Y%m%d_%H%M%S') || '.csv' AS export_name
FROM customer""")
def scalar_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Tree labels, byte formatting and export names derived from customers."""
    c = t(spark, sf, "customer")
    key = F.col("c_custkey").cast("long")
    rows = F.when(F.col("c_acctbal") >= 0, key * 1237)
    year = (F.lit(1990) + F.col("c_nationkey")).cast("string")
    month = (F.col("c_custkey") % 12 + 1).cast("string")
    status = F.when(F.col("c_mktsegment") != "MACHINERY", F.lower("c_mktsegment"))
    stamp = F.timestamp_add("SECOND", F.col("c_custkey"), F.lit("2026-05-01 10:00:00").cast("timestamp_ntz"))
    return c.select(
        "c_custkey",
        file_label(F.col("c_name"), key * 12345678, rows).alias("file_label"),
        format_bytes(key * key * 3001).alias("size_text"),
        year_label(year).alias("year_label"),
        month_label(year, month, F.concat(year, F.lit("_"), month), status).alias("month_label"),
        export_name(F.concat(year, F.lit("_"), month), F.lit("csv"), stamp).alias("export_name"))
