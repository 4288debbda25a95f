"""Library views over documents, labels, conversations, pages and the catalogue.

Bindings used here:
* a landed file per document: ``<source>/doc_<id><ext>`` with ``ext`` by
  language (en → .zip, fr → .csv, es → .CSV, de → .txt), on-disk size
  ``n_chars``, mtime ``doc_id * 1000``;
* the stats cache: one entry per labelled document (toxic ones recorded with
  a stale size, so they miss);
* manifest rows: labels; catalogue rows: conversations (by file basename).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.functions.text import usage_label
from dropledger.operators.changelog import fold_state
from dropledger.operators import anchors
from dropledger.operators.library import (
    ANCHOR_PATTERN,
    first_links,
    flatten_tree,
    manifest_remove,
    manifest_upsert,
    match_links,
    nest_manifest,
    nest_tree,
    search_tree,
    tree_ranks,
    union_by_name,
    union_positional,
)
from dropledger.operators.outcomes import newline_rows
from dropledger.operators.reconcile import evict_stale, memo_lookup, precedence_merge, update_by_presence
from dropledger.plans.bindings import FILELOG_SQL, file_log, sql_with, t
from dropledger.plans.calendar_plans import publications
from dropledger.plans.registry import query
from dropledger.session import shared_scratch
from dropledger.functions.calendar import DATA_ROOT_URL, publication_date, publish_info_from_key
from dropledger.sources.jsondocs import MANIFEST_SCHEMA, read_manifests, write_manifests

def _ext():
    return (F.when(F.col("lang") == "en", ".zip").when(F.col("lang") == "fr", ".csv")
            .when(F.col("lang") == "es", ".CSV").otherwise(".txt"))


_EXT_SQL = "CASE lang WHEN 'en' THEN '.zip' WHEN 'fr' THEN '.csv' WHEN 'es' THEN '.CSV' ELSE '.txt' END"
_ROWS_SQL = "CAST(greatest(length(text) - length(replace(text, chr(10), '')) - 1, 0) AS BIGINT)"


def listing(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), _ext()).alias("path"),
        F.col("n_chars").cast("long").alias("length"),
        (F.col("doc_id") * 1000).cast("long").alias("mtime"),
        "text", "lang")


LISTING_SQL = f"""listing AS (
  SELECT doc_id, source || '/doc_' || CAST(doc_id AS VARCHAR) || {_EXT_SQL} AS path,
         CAST(n_chars AS BIGINT) AS length, CAST(doc_id * 1000 AS BIGINT) AS mtime, text, lang
  FROM documents)"""


@query("file_stats", sql_with(LISTING_SQL) + f"""
SELECT doc_id, path,
       CASE WHEN lower(path) LIKE '%.csv' OR lower(path) LIKE '%.zip' THEN {_ROWS_SQL} END AS row_count,
       CASE WHEN lower(path) LIKE '%.zip' THEN coalesce(nullif(CAST(strlen(text) AS BIGINT), 0), length)
            ELSE length END AS display_size
FROM listing""")
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    """(row count, display size) per file: rows only for .csv/.zip; a ZIP shows
    its uncompressed member size when non-zero, everything else its on-disk size."""
    li = listing(spark, sf)
    low = F.lower("path")
    counted = low.endswith(".csv") | low.endswith(".zip")
    return li.select(
        "doc_id", "path",
        F.when(counted, newline_rows("text")).alias("row_count"),
        F.when(low.endswith(".zip"), F.coalesce(F.nullif(F.octet_length("text").cast("long"), F.lit(0)), F.col("length")))
        .otherwise(F.col("length")).alias("display_size"))


def stats_cache(spark: SparkSession, sf: str) -> DataFrame:
    lab = t(spark, sf, "labels")
    # Counted and measured where the text is read; only that is joined.
    li = listing(spark, sf).select("doc_id", "path", "length", "mtime", newline_rows("text").alias("row_count"),
                                   F.octet_length("text").cast("long").alias("bytes"))
    j = li.join(lab, "doc_id")
    return j.select(
        "path",
        (F.col("length") + F.col("toxic")).alias("length"),
        "mtime",
        "row_count",
        F.when(F.col("quality") == 1, F.col("bytes")).otherwise(F.lit(0).cast("long")).alias("uncompressed_size"),
        "quality", "toxic")


CACHE_SQL = f"""cache AS (
  SELECT path, length + toxic AS length, mtime, {_ROWS_SQL} AS row_count,
         CASE WHEN quality = 1 THEN CAST(strlen(text) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS uncompressed_size,
         quality, toxic
  FROM listing JOIN labels USING (doc_id))"""


@query("stats_memo", sql_with(LISTING_SQL, CACHE_SQL) + f"""
, memo AS (
  SELECT l.doc_id, l.path, l.lang,
         CASE WHEN c.path IS NOT NULL THEN coalesce(nullif(c.uncompressed_size, 0), l.length) ELSE l.length END AS display_size,
         CASE WHEN c.path IS NOT NULL THEN c.row_count END AS row_count,
         c.path IS NOT NULL AS cache_hit,
         l.text
  FROM listing l LEFT JOIN cache c ON l.path = c.path AND l.length = c.length AND l.mtime = c.mtime)
SELECT doc_id, path, display_size, cache_hit, row_count IS NULL AS needs_stats,
       CASE WHEN row_count IS NULL THEN {_ROWS_SQL} ELSE row_count END AS row_count
FROM memo""")
def stats_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Memoised file statistics: hits from the cache, misses flagged for a
    statistics job, then the fresh results of all misses applied by path."""
    li = listing(spark, sf)
    memo = memo_lookup(li.select("doc_id", "path", "length", "mtime", "lang"), stats_cache(spark, sf))
    memo = memo.withColumn("needs_stats", F.col("row_count").isNull())
    misses = memo.filter("needs_stats").select("path")
    fresh = li.select("path", newline_rows("text").alias("row_count")).join(misses, "path", "left_semi")
    out = update_by_presence(memo, fresh, "path", ["row_count"])
    return out.select("doc_id", "path", "display_size", "cache_hit", "needs_stats", "row_count")


@query("stats_evict", sql_with(LISTING_SQL, CACHE_SQL) + """
, c2 AS (SELECT CASE WHEN toxic = 1 THEN replace(path, '/doc_', '/old_') ELSE path END AS path,
                CASE WHEN quality = 0 AND toxic = 0 THEN NULL ELSE mtime END AS mtime FROM cache)
SELECT count_if(NOT alive) AS removed, count_if(alive) AS kept FROM (
  SELECT mtime IS NOT NULL AND path IN (SELECT path FROM listing WHERE lang <> 'de')
         AND path IN (SELECT path FROM listing) AS alive FROM c2)""")
def stats_evict(spark: SparkSession, sf: str) -> DataFrame:
    """Evict cache rows that are malformed, not in the valid set, or whose file is gone."""
    cache = stats_cache(spark, sf).select(
        F.when(F.col("toxic") == 1, F.regexp_replace("path", "/doc_", "/old_")).otherwise(F.col("path")).alias("path"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(None)).otherwise(F.col("mtime")).alias("mtime"))
    li = listing(spark, sf)
    keep, gone = evict_stale(cache, li, li.filter(F.col("lang") != "de"), "path",
                             well_formed=F.col("mtime").isNotNull())
    flag = keep.select(F.lit(True).alias("alive")).unionByName(gone.select(F.lit(False).alias("alive")))
    return flag.agg(F.count_if(~F.col("alive")).alias("removed"), F.count_if("alive").alias("kept"))


# Fixed query parameter: capacity of the volume holding the library, in bytes.
CAPACITY_BYTES = 1_000_000


def _gb_sql(x: str) -> str:
    return f"CAST(CAST(round_even(CAST({x} AS DECIMAL(20,0)) / CAST(1073741824 AS DECIMAL(20,0)), 2) AS DECIMAL(24,2)) AS VARCHAR)"


@query("storage_usage", f"""
WITH s AS (SELECT coalesce(source, '*') AS source, CAST(sum(strlen(text)) AS BIGINT) AS bytes
           FROM documents GROUP BY ROLLUP (source))
SELECT source, bytes,
       {_gb_sql('bytes')} || ' GB / ' || {_gb_sql(str(CAPACITY_BYTES))} || ' GB（'
       || CAST(CAST(round_even(CAST(bytes AS DECIMAL(20,0)) * CAST(100 AS DECIMAL(20,0)) / CAST({CAPACITY_BYTES} AS DECIMAL(20,0)), 1) AS DECIMAL(24,1)) AS VARCHAR)
       || '% 使用）' AS label
FROM s""")
def storage_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes per source folder and for the whole library (ROLLUP), with the usage label."""
    d = t(spark, sf, "documents")
    s = d.rollup("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return s.select(F.coalesce("source", F.lit("*")).alias("source"), "bytes",
                    usage_label(F.col("bytes"), F.lit(CAPACITY_BYTES)).alias("label"))


@query("latest_generation", """
SELECT event_id, user_id, CAST(ts AS DATE) AS generation FROM events
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Accept only results of the current (latest) generation."""
    e = t(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("generation"))
    current = e.select(F.max("generation")).scalar()  # scalar subquery: the current generation
    return e.filter(F.col("generation") == current)


_MERGE_FIELDS = ["display_name", "target_code", "sha256", "source_url", "downloaded_at"]


@query("catalog_merge", """
WITH disk AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.zip' AS file_name FROM documents),
man AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.zip' AS file_name, 'label ' || CAST(doc_id AS VARCHAR) AS display_name,
               'q' || CAST(quality AS VARCHAR) AS target_code,
               CASE WHEN toxic = 1 THEN NULL ELSE 'h' || CAST(doc_id AS VARCHAR) END AS sha256,
               'https://example.invalid/' || CAST(doc_id AS VARCHAR) AS source_url, NULL::VARCHAR AS downloaded_at
        FROM labels),
cat_rows AS (SELECT 'doc_' || CAST(conv_id AS VARCHAR) || '.zip' AS file_name,
                    'conv ' || CAST(conv_id AS VARCHAR) || ' turn ' || CAST(turn AS VARCHAR) AS display_name,
                    role || '_' || lpad(CAST(turn AS VARCHAR), 19, '0') AS target_code,
                    'c' || CAST(conv_id AS VARCHAR) AS sha256, NULL::VARCHAR AS source_url,
                    '2024-01-01T00:00:00+09:00' AS downloaded_at, 'ok' AS status
             FROM conversations),
cat AS (SELECT file_name, arg_max(display_name, target_code) AS display_name, max(target_code) AS target_code,
               arg_max(sha256, target_code) AS sha256, arg_max(source_url, target_code) AS source_url,
               arg_max(downloaded_at, target_code) AS downloaded_at, arg_max(status, target_code) AS status
        FROM cat_rows GROUP BY file_name)
SELECT d.file_name,
       CASE WHEN m.file_name IS NOT NULL THEN m.display_name WHEN c.file_name IS NOT NULL THEN c.display_name
            ELSE regexp_replace(d.file_name, '\\.[^.]*$', '') END AS display_name,
       CASE WHEN m.file_name IS NOT NULL THEN m.target_code WHEN c.file_name IS NOT NULL THEN c.target_code END AS target_code,
       CASE WHEN m.file_name IS NOT NULL THEN m.sha256 WHEN c.file_name IS NOT NULL THEN c.sha256 END AS sha256,
       CASE WHEN m.file_name IS NOT NULL THEN m.source_url WHEN c.file_name IS NOT NULL THEN c.source_url END AS source_url,
       CASE WHEN m.file_name IS NOT NULL THEN m.downloaded_at WHEN c.file_name IS NOT NULL THEN c.downloaded_at END AS downloaded_at,
       CASE WHEN m.file_name IS NOT NULL THEN 'manifest' WHEN c.file_name IS NOT NULL THEN 'catalogue' ELSE 'disk' END AS source_kind,
       c.status
FROM disk d LEFT JOIN man m ON d.file_name = m.file_name LEFT JOIN cat c ON d.file_name = c.file_name""")
def catalog_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Disk ⟕ manifest (by file name) ⟕ catalogue (by path basename), whole-row precedence."""
    from dropledger.functions.text import basename, stem
    disk = t(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("file_name"))
    lab = t(spark, sf, "labels")
    man = lab.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("file_name"),
        F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("display_name"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("target_code"),
        F.when(F.col("toxic") != 1, F.concat(F.lit("h"), F.col("doc_id").cast("string"))).alias("sha256"),
        F.concat(F.lit("https://example.invalid/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.lit(None).cast("string").alias("downloaded_at"))
    conv = t(spark, sf, "conversations")
    rows = conv.select(
        F.concat(F.lit("month/x/doc_"), F.col("conv_id").cast("string"), F.lit(".zip")).alias("file_path"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string"), F.lit(" turn "), F.col("turn").cast("string"))
        .alias("display_name"),
        F.concat(F.col("role"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 19, "0")).alias("target_code"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sha256"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit("2024-01-01T00:00:00+09:00").alias("downloaded_at"),
        F.lit("ok").alias("status"))
    # Several catalogue rows can share a basename: the last in code order wins.
    cat = fold_state(rows.withColumn("file_name", basename("file_path")), keys=["file_name"],
                     seq="target_code", last=_MERGE_FIELDS + ["status"])
    return precedence_merge(disk, man, cat, "file_name", _MERGE_FIELDS, stem(F.col("file_name")))


@query("fuzzy_key_match", """
WITH tg AS (SELECT DISTINCT p_name AS code, p_name AS display_name, replace(p_name, ' ', '_') AS filename_key FROM part),
links AS (
  SELECT upper(p_name) AS display_name, replace(p_name, ' ', '_') AS filename_key, 0 AS kind, p_partkey AS at
  FROM part WHERE p_brand = 'Brand#1' AND p_size > 45
  UNION ALL
  SELECT w AS display_name, 'w_' || w AS filename_key, 1 AS kind, min(p_partkey) AS at
  FROM (SELECT split_part(p_name, ' ', 2) AS w, p_partkey FROM part) GROUP BY w),
ex AS (SELECT DISTINCT filename_key AS k, filename_key AS ek FROM links),
t1 AS (SELECT tg.*, ex.ek FROM tg LEFT JOIN ex ON tg.filename_key = ex.k),
fz AS (SELECT t1.code, first(l.filename_key ORDER BY l.kind, l.at) AS fk FROM t1 JOIN links l
       ON contains(t1.display_name, l.display_name) OR contains(l.display_name, t1.display_name)
       WHERE t1.ek IS NULL GROUP BY t1.code)
SELECT t1.code, t1.display_name, coalesce(ek, fk, filename_key) AS filename_key,
       CASE WHEN ek IS NOT NULL THEN 'exact' WHEN fk IS NOT NULL THEN 'contains' ELSE 'none' END AS match_kind
FROM t1 LEFT JOIN fz ON t1.code = fz.code""")
def fuzzy_key_match(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as targets; links = a few exact names plus the distinct second words."""
    p = t(spark, sf, "part")
    tg = p.select(F.col("p_name").alias("code"), F.col("p_name").alias("display_name"),
                  F.regexp_replace("p_name", " ", "_").alias("filename_key")).distinct()
    exact = (p.filter((F.col("p_brand") == "Brand#1") & (F.col("p_size") > 45))
             .select(F.upper("p_name").alias("display_name"),
                     F.regexp_replace("p_name", " ", "_").alias("filename_key"),
                     F.struct(F.lit(0).alias("kind"), F.col("p_partkey").alias("at")).alias("pos")))
    words = (p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w"), "p_partkey")
             .groupBy("w").agg(F.min("p_partkey").alias("at"))
             .select(F.col("w").alias("display_name"), F.concat(F.lit("w_"), F.col("w")).alias("filename_key"),
                     F.struct(F.lit(1).alias("kind"), "at").alias("pos")))
    return match_links(tg, exact.unionByName(words))


# Fixed query parameter: key pattern applied to each anchor's href.
PAGE_KEY_PATTERN = r"/([A-Za-z0-9_]+)"


_ANCHOR_SQL = ANCHOR_PATTERN.replace("'", "''")


@query("html_links", f"""
WITH a AS (SELECT page_id, unnest(m) AS a, generate_subscripts(m, 1) - 1 AS pos
           FROM (SELECT page_id, regexp_extract_all(html, '{_ANCHOR_SQL}', 0) AS m FROM pages)),
b AS (SELECT page_id, pos, regexp_extract(a, '{_ANCHOR_SQL}', 1) || regexp_extract(a, '{_ANCHOR_SQL}', 2) AS href,
             regexp_replace(regexp_extract(a, '{_ANCHOR_SQL}', 3), '<[^>]*>', '', 'g') AS text FROM a),
c AS (SELECT *, lower(regexp_extract(href, '{PAGE_KEY_PATTERN}', 1)) AS link_key FROM b)
SELECT page_id, link_key, min(pos) AS pos, arg_min(href, pos) AS url,
       coalesce(nullif(trim(arg_min(text, pos)), ''), link_key) AS link_text
FROM c WHERE link_key <> '' GROUP BY page_id, link_key""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed links of every page; the first anchor per (page, key) wins."""
    return first_links(t(spark, sf, "pages"), "html", PAGE_KEY_PATTERN)


# Fixed query parameter: a link's key is the first word of its path.
LINK_KEY_PATTERN = r"://[^/]+/([A-Za-z0-9_]+)"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _decoded_sql(x: str) -> str:
    """``anchors.decode_entities`` for numeric entities in decimal and the named ones."""
    out = (f"array_to_string(list_transform(regexp_extract_all({x}, '{_quoted(anchors.ENTITY_OR_TEXT)}'), lambda p: CASE "
           "WHEN regexp_matches(p, '^&#[0-9]') THEN chr(CAST(regexp_extract(p, '[0-9]+') AS INTEGER)) "
           "WHEN regexp_matches(p, '^&#[xX]') THEN chr(CAST('0x' || regexp_extract(p, '[xX]([0-9a-fA-F]+)', 1) AS INTEGER)) ELSE p END), '')")
    for name, value in anchors.ENTITIES.items():
        out = f"replace({out}, '&{name};', '{_quoted(value)}')"
    return out


# The pages' addresses have no dot parts, so SQL resolves without removing them.
@query("page_links", f"""
WITH plain AS (SELECT page_id, url AS base, regexp_replace(regexp_replace(html, '{anchors.CONTROLS}', '', 'g'),
                      '{_quoted(anchors.markup_pattern(""))}', '\\1', 'g') AS h FROM pages),
marked AS (SELECT page_id, base, regexp_replace(regexp_replace(h, '{_quoted(anchors.open_pattern(""))}', chr(1) || '\\1' || chr(2), 'g'),
                  '{anchors.CLOSE_PATTERN}', chr(3), 'g') AS h FROM plain),
a AS (SELECT page_id, base, unnest(regexp_extract_all(h, '{anchors.ANCHOR}', 1)) AS attrs,
             unnest(regexp_extract_all(h, '{anchors.ANCHOR}', 2)) AS content,
             unnest(range(len(regexp_extract_all(h, '{anchors.ANCHOR}', 1)))) AS pos FROM marked),
t AS (SELECT *, list_filter(regexp_extract_all(attrs, '{_quoted(anchors.ATTRIBUTE)}'), lambda x: regexp_matches(x, '{anchors.HREF}'))[1] AS token FROM a),
h AS (SELECT *, trim({_decoded_sql(f"regexp_replace(regexp_replace(token, '{anchors.HREF}', ''), '{_quoted(anchors.QUOTED)}', chr(92) || '1' || chr(92) || '2')")}) AS href,
             regexp_extract(base, '{anchors.ORIGIN}') AS origin, regexp_extract(base, '{anchors.ORIGIN}([^?#]*)', 1) AS path,
             regexp_replace(base, '#.*$', '') AS page
      FROM t WHERE token IS NOT NULL),
u AS (SELECT page_id, pos, trim(regexp_replace({_decoded_sql('content')}, '\\s+', ' ', 'g')) AS text,
             CASE WHEN href = '' THEN page WHEN regexp_matches(href, '{anchors.ABSOLUTE}') THEN href
                  WHEN starts_with(href, '//') THEN regexp_extract(base, '{anchors.ABSOLUTE}') || href
                  WHEN starts_with(href, '/') THEN origin || href WHEN starts_with(href, '?') THEN origin || path || href
                  WHEN starts_with(href, '#') THEN page || href
                  ELSE origin || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || href END AS url FROM h),
k AS (SELECT *, lower(regexp_extract(url, '{LINK_KEY_PATTERN}', 1)) AS link_key FROM u)
SELECT page_id, link_key, CAST(min(pos) AS INTEGER) AS pos, arg_min(url, pos) AS url, coalesce(nullif(arg_min(text, pos), ''), link_key) AS link_text
FROM k WHERE link_key <> '' GROUP BY page_id, link_key""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed links of every page as its document shows them, resolved against its address; the first per (page, key) wins."""
    return anchors.document_links(t(spark, sf, "pages"), "html", LINK_KEY_PATTERN, url="url")


# --- manifests ----------------------------------------------------------------

_ENTRY_FIELDS = ["target_code", "display_name", "filename", "source_url", "size", "sha256", "downloaded_at"]

def manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest entries: the latest succeeded file per (month, target)."""
    log = file_log(spark, sf).filter(F.col("outcome") == "succeeded")
    f = fold_state(log, keys=["publish_ym", "target_code"], seq=["o_orderdate", "o_orderkey"],
                   last=["display_name", "o_orderkey", "file_path", "o_orderdate"])
    return f.select(
        "publish_ym", "target_code", "display_name",
        F.concat("display_name", F.lit(".zip")).alias("filename"),
        F.concat(F.lit("https://example.invalid/"), F.col("file_path")).alias("source_url"),
        (F.col("o_orderkey") * 10).cast("long").alias("size"),
        F.sha2(F.col("file_path"), 256).alias("sha256"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("downloaded_at"))


ENTRIES_SQL = sql_with(FILELOG_SQL) + """, entries AS (
  SELECT publish_ym, target_code, arg_max(display_name, (o_orderdate, o_orderkey)) AS display_name,
         arg_max(display_name, (o_orderdate, o_orderkey)) || '.zip' AS filename,
         'https://example.invalid/' || arg_max(file_path, (o_orderdate, o_orderkey)) AS source_url,
         CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) * 10 AS BIGINT) AS size,
         sha256(arg_max(file_path, (o_orderdate, o_orderkey))) AS sha256,
         strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS downloaded_at
  FROM filelog WHERE outcome = 'succeeded' GROUP BY publish_ym, target_code)
"""


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per month: publication date (data month + 2, ISO), the
    month's directory URL, and no app version for January folders (a field
    the reader must default)."""
    e = manifest_entries(spark, sf)
    info = publish_info_from_key(F.col("publish_ym"))
    return nest_manifest(
        e, "publish_ym",
        [publication_date(info["publish_year"], info["publish_month"]).alias("publish_date"),
         F.max("downloaded_at").alias("downloaded_at"),
         info["dir_url"].alias("source_dir_url"),
         F.when(F.col("publish_ym").endswith("_1"), F.lit(None).cast("string")).otherwise(F.lit("1.0"))
         .alias("app_version")],
        _ENTRY_FIELDS)


_NEST_SQL = ENTRIES_SQL + """, docs AS (
  SELECT publish_ym, count(*) AS n_files,
         to_json(struct_pack(publish_ym := publish_ym,
                 publish_date := strftime(make_date(CAST(split_part(publish_ym, '_', 1) AS INTEGER),
                                                    CAST(split_part(publish_ym, '_', 2) AS INTEGER), 1) + INTERVAL 2 MONTH, '%Y-%m-%d'),
                 downloaded_at := max(downloaded_at),
                 source_dir_url := '""" + DATA_ROOT_URL + """'
                     || strftime(make_date(CAST(split_part(publish_ym, '_', 1) AS INTEGER),
                                           CAST(split_part(publish_ym, '_', 2) AS INTEGER), 1) + INTERVAL 2 MONTH, '%Y%m') || '010000/',
                 app_version := CASE WHEN ends_with(publish_ym, '_1') THEN NULL ELSE '1.0' END,
                 files := list(struct_pack(target_code := target_code, display_name := display_name, filename := filename,
                                           source_url := source_url, size := size, sha256 := sha256,
                                           downloaded_at := downloaded_at) ORDER BY target_code, display_name, filename,
                                           source_url, size, sha256, downloaded_at))) AS manifest_json
  FROM entries GROUP BY publish_ym)
"""


@query("manifest_nest", _NEST_SQL + "SELECT * FROM docs")
def manifest_nest(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON manifest per month: header + files sorted by code."""
    return _manifests(spark, sf)


@query("manifest_explode", ENTRIES_SQL + """
SELECT e.publish_ym, CASE WHEN ends_with(e.publish_ym, '_1') THEN '0.0.0' ELSE '1.0' END AS app_version,
       CAST(row_number() OVER (PARTITION BY e.publish_ym ORDER BY target_code) - 1 AS INTEGER) AS pos,
       target_code, display_name, filename, size, target_code = 'nation_7' AS is_lookup_hit
FROM entries e""")
def manifest_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests written as ``<month>/_manifest.json`` files, read back (missing
    version → default) and exploded; flags the entry a by-code lookup returns."""
    root = shared_scratch(spark, "manifests")
    written = write_manifests(_manifests(spark, sf), root)
    # The write's result (one row per month) is itself written, so the files
    # exist before they are read and the writing stage never re-runs.
    written.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder")) \
        .write.mode("overwrite").parquet(root + "/_written")
    rows = read_manifests(spark.read.parquet(root + "/_written"))
    first_hit = (rows.filter(F.col("target_code") == "nation_7")
                 .groupBy("publish_ym").agg(F.min("pos").alias("_hit_pos")))
    out = rows.join(first_hit, "publish_ym", "left")
    return out.select("publish_ym", "app_version", "pos", "target_code", "display_name", "filename", "size",
                      F.coalesce(F.col("pos") == F.col("_hit_pos"), F.lit(False)).alias("is_lookup_hit"))


@query("manifest_edit", ENTRIES_SQL + """
, lst AS (SELECT publish_ym, list(target_code ORDER BY target_code) AS codes,
                 list(display_name ORDER BY target_code) AS names FROM entries GROUP BY publish_ym)
SELECT publish_ym,
       array_to_string(list_filter(CASE WHEN list_contains(codes, 'nation_0') THEN codes ELSE list_concat(codes, ['nation_0']) END,
                                   lambda c: c <> 'nation_1'), ',') AS codes,
       array_to_string(list_filter(
           CASE WHEN list_contains(codes, 'nation_0')
                THEN list_transform(list_zip(codes, names), lambda z: CASE WHEN z[1] = 'nation_0' THEN 'NATION_0 (updated)' ELSE z[2] END)
                ELSE list_concat(names, ['NATION_0 (updated)']) END,
           lambda n: n <> 'NATION_1'), ',') AS names
FROM lst""")
def manifest_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Per month: upsert the ``nation_0`` entry (in place or appended), remove ``nation_1``."""
    docs = _manifests(spark, sf).select("publish_ym", F.from_json("manifest_json", MANIFEST_SCHEMA)["files"].alias("files"))
    new_entry = F.struct(F.lit("nation_0").alias("target_code"), F.lit("NATION_0 (updated)").alias("display_name"),
                         F.lit("NATION_0.zip").alias("filename"), F.lit(None).cast("string").alias("source_url"),
                         F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"),
                         F.lit(None).cast("string").alias("downloaded_at"))
    edited = docs.withColumn("files", manifest_upsert("files", new_entry))
    edited = edited.withColumn("files", manifest_remove("files", F.lit("nation_1")))
    return edited.select("publish_ym",
                         F.array_join(F.transform("files", lambda x: x["target_code"]), ",").alias("codes"),
                         F.array_join(F.transform("files", lambda x: x["display_name"]), ",").alias("names"))


# --- the library tree -----------------------------------------------------------

def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files in month folders: region ZIPs, plus the merged CSV where the month is complete."""
    f = fold_state(file_log(spark, sf), keys=["publish_ym", "target_code"], seq=["o_orderdate", "o_orderkey"],
                   last=["display_name", "o_orderpriority", "o_orderdate"])
    zips = f.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
                    F.lit(1).alias("kind"), F.concat("display_name", F.lit(".zip")).alias("file_name"),
                    F.concat_ws(" ", "display_name", "o_orderpriority").alias("display_name"))
    pubs = publications(spark, sf).filter(F.col("status") == "complete")
    merged = pubs.select(F.col("data_year").alias("year"), F.col("data_month").alias("month"),
                         F.lit(0).alias("kind"), F.lit("統合.csv").alias("file_name"),
                         F.lit("統合CSV").alias("display_name"))
    return zips.unionByName(merged)


_TREE_SQL = sql_with(FILELOG_SQL) + """, f AS (
  SELECT publish_ym, target_code, arg_max(display_name, (o_orderdate, o_orderkey)) AS dn,
         arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr, max(o_orderdate) AS od
  FROM filelog GROUP BY ALL),
pubs AS (SELECT publish_ym, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st,
                CAST(year(max(o_orderdate)) AS INTEGER) AS y, CAST(month(max(o_orderdate)) AS INTEGER) AS m
         FROM orders JOIN (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR) AS publish_ym FROM orders) x
              ON o_orderkey = k GROUP BY publish_ym),
files AS (
  SELECT CAST(year(od) AS INTEGER) AS year, CAST(month(od) AS INTEGER) AS month, 1 AS kind,
         dn || '.zip' AS file_name, dn || ' ' || pr AS display_name FROM f
  UNION ALL
  SELECT y, m, 0, '統合.csv', '統合CSV' FROM pubs WHERE st = 'F')
"""


@query("tree_nest", _TREE_SQL + """
SELECT year, month, file_name, CAST(count(*) OVER (PARTITION BY year, month) AS INTEGER) AS month_file_count,
       CAST(count(DISTINCT month) OVER (PARTITION BY year) AS INTEGER) AS year_month_count
FROM files""")
def tree_nest(spark: SparkSession, sf: str) -> DataFrame:
    """Year → month → file nesting and its flattening back to file rows."""
    tree = nest_tree(tree_files(spark, sf), file_fields=["file_name"])
    return flatten_tree(tree).select("year", "month", "file_name", "month_file_count", "year_month_count")


@query("tree_sorted", _TREE_SQL + """
, mr AS (SELECT DISTINCT year, month FROM files)
SELECT f.year, f.month, f.file_name,
       (SELECT count(*) FROM mr WHERE mr.year > f.year OR (mr.year = f.year AND mr.month > f.month)) + 1 AS month_rank_desc,
       (SELECT count(*) FROM mr WHERE mr.year > f.year OR (mr.year = f.year AND mr.month < f.month)) + 1 AS month_rank_asc,
       row_number() OVER (PARTITION BY f.year, f.month ORDER BY kind, file_name) AS file_rank_date,
       row_number() OVER (PARTITION BY f.year, f.month ORDER BY display_name) AS file_rank_name
FROM files f""")
def tree_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The three library orders as (month rank, rank inside the month)."""
    return tree_ranks(tree_files(spark, sf)).select(
        "year", "month", "file_name", "month_rank_desc", "month_rank_asc", "file_rank_date", "file_rank_name")


# Fixed query parameter: the search text typed by the user.
SEARCH_TEXT = "  Nation_1 1-URGENT "


@query("tree_search", _TREE_SQL + f"""
, h AS (SELECT *, contains(lower(display_name), lower(trim('{SEARCH_TEXT}'))) AS hit FROM files),
mv AS (SELECT year, month, bool_or(hit) AS month_visible FROM h GROUP BY ALL),
yv AS (SELECT year, bool_or(month_visible) AS year_visible FROM mv GROUP BY ALL)
SELECT h.year, h.month, h.file_name, h.hit AND mv.month_visible AS file_visible, month_visible, year_visible
FROM h JOIN mv USING (year, month) JOIN yv USING (year)""")
def tree_search(spark: SparkSession, sf: str) -> DataFrame:
    r = search_tree(tree_files(spark, sf), SEARCH_TEXT)
    return r.select("year", "month", "file_name", "file_visible", "month_visible", "year_visible")


# --- unions -----------------------------------------------------------------------

_U_COLS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]


@query("union_by_name", "SELECT " + ", ".join(_U_COLS) + " FROM lineitem")
def union_by_name_q(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem split by return flag with shuffled column orders, unioned by name."""
    li = t(spark, sf, "lineitem").select(*_U_COLS)
    other = ~F.coalesce(F.col("l_returnflag").isin("A", "N"), F.lit(False))
    parts = [li.filter(F.col("l_returnflag") == "A").select(*_U_COLS),
             li.filter(F.col("l_returnflag") == "N").select(*reversed(_U_COLS)),
             li.filter(other).select(*_U_COLS[2:], *_U_COLS[:2])]
    return union_by_name(parts)


@query("union_positional", """
SELECT l_orderkey AS a, l_linenumber AS b, l_returnflag AS c, l_quantity AS d FROM lineitem""")
def union_positional_q(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with differing names but equal arity; names from the first non-empty frame."""
    li = t(spark, sf, "lineitem").select(*_U_COLS)
    empty = li.filter(F.lit(False)).toDF("x1", "x2", "x3", "x4")
    parts = [empty,
             li.filter(F.col("l_returnflag") == "A").toDF("a", "b", "c", "d"),
             li.filter(F.col("l_returnflag") == "N").toDF("w", "x", "y", "z"),
             li.filter(~F.coalesce(F.col("l_returnflag").isin("A", "N"), F.lit(False)))]
    return union_positional(parts)
