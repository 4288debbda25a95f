"""ZIP/CSV ingest, merge, extract and bundle over archives derived from lineitem.

The archive library is written by a Spark job from ``lineitem`` (one ZIP per
ship quarter × return flag, cp932 text for flags A/N and UTF-8 for R; each
archive holds ``readme.txt``, the data CSV and a decoy ``extra.csv``), plus a
few decoy folders the scan must skip, manifests for the March folders
(derived from the rows), a broken manifest in one folder, catalogue rows for
the September folders and month statuses from ``lineitem``.  It is built
once per session and data directory, in the shared scratch folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.plans.bindings import t
from dropledger.plans.registry import query
from dropledger.session import shared_scratch
from dropledger.operators.library import nest_manifest
from dropledger.sources import jsondocs, zipcsv
from dropledger.sources.library import scan_library, scan_library_cached

_COLUMNS = ["orderkey", "linenumber", "quantity", "shipdate", "note"]
_LIBS: dict[tuple[str, str], str] = {}


def _ym(col):
    return F.concat(F.year(col).cast("string"), F.lit("_"), (F.quarter(col) * 3).cast("string"))


def archive_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    note = F.when(F.col("l_linenumber") == 1,
                  F.concat(F.lit('備考\n"'), F.col("l_linestatus"), F.lit('", 行'))) \
        .otherwise(F.concat(F.lit("区分 "), F.col("l_returnflag"), F.col("l_linestatus")))
    return li.select(
        _ym("l_shipdate").alias("publish_ym"), F.col("l_returnflag").alias("flag"),
        F.col("l_orderkey").cast("string").alias("orderkey"),
        F.col("l_linenumber").cast("string").alias("linenumber"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"),
        note.alias("note"))


def library_root(spark: SparkSession, sf: str) -> str:
    """Write (once per application and data dir) the archive library; return its root."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key in _LIBS:
        return _LIBS[key]
    root = shared_scratch(spark, "library")
    rows = archive_rows(spark, sf)
    zipcsv.write_archives(
        rows, root, ym=F.col("publish_ym"), label=F.concat(F.lit("flag_"), F.col("flag")),
        member=F.concat(F.lit("data_"), F.col("flag"), F.lit(".csv")),
        encoding=F.when(F.col("flag") == "R", F.lit("utf-8")).otherwise(F.lit("cp932")),
        columns=_COLUMNS, order=_COLUMNS).write.format("noop").mode("overwrite").save()  # runs the writer job
    # Decoys the library scan must skip, and one merged CSV it must list first.
    for sub in ("not_a_month", ".hidden/2020_1", "1999_13"):
        os.makedirs(os.path.join(root, sub), exist_ok=True)
        with open(os.path.join(root, sub, "decoy.zip"), "wb") as fh:
            fh.write(b"not an archive")
    with open(os.path.join(root, "1995_3", zipcsv.MERGED_CSV_NAME), "w", encoding="cp932") as fh:
        fh.write("orderkey\n1\n")
    # Manifests for the March-ending months (derived from the rows), and one
    # folder whose manifest is not valid JSON (the library view drops it).
    jsondocs.write_manifests(_fixture_manifests(rows), root).write.format("noop").mode("overwrite").save()
    with open(os.path.join(root, BROKEN_MANIFEST_YM, jsondocs.MANIFEST_FILE_NAME), "w") as fh:
        fh.write("{not json")
    _LIBS[key] = root
    return root


BROKEN_MANIFEST_YM = "1996_6"


def _fixture_manifests(rows: DataFrame) -> DataFrame:
    m = rows.filter(F.col("publish_ym").endswith("_3")).groupBy("publish_ym", "flag").agg(F.count(F.lit(1)).alias("n"))
    entries = m.select(
        "publish_ym", F.lower("flag").alias("target_code"),
        F.concat(F.lit("Flag "), F.col("flag"), F.lit(" "), F.col("publish_ym")).alias("display_name"),
        F.concat(F.lit("flag_"), F.col("flag"), F.lit(".zip")).alias("filename"),
        F.lit("https://example.invalid/").alias("source_url"), F.col("n").alias("size"),
        F.lit("m").alias("sha256"), F.lit("2026-05-01T10:00:00+09:00").alias("downloaded_at"))
    header = [F.concat(F.first("publish_ym"), F.lit("-01")).alias("publish_date"),
              F.lit("2026-05-01T10:00:00+09:00").alias("downloaded_at"),
              F.lit("https://example.invalid/d/").alias("source_dir_url"), F.lit("1.0").alias("app_version")]
    return nest_manifest(entries, "publish_ym", header,
                         ["target_code", "display_name", "filename", "source_url", "size", "sha256", "downloaded_at"])


def _zips(spark: SparkSession, sf: str) -> DataFrame:
    return zipcsv.library_listing(spark, library_root(spark, sf)).filter(F.col("kind") == 1)


_YM_SQL = "CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(quarter(l_shipdate) * 3 AS VARCHAR)"
_NOTE_SQL = """CASE WHEN l_linenumber = 1 THEN '備考' || chr(10) || '"' || l_linestatus || '", 行'
                 ELSE '区分 ' || l_returnflag || l_linestatus END"""
_ROWS_SQL = f"""rows AS (
  SELECT {_YM_SQL} AS publish_ym, l_returnflag AS flag, CAST(l_orderkey AS VARCHAR) AS orderkey,
         CAST(l_linenumber AS VARCHAR) AS linenumber, CAST(l_quantity AS VARCHAR) AS quantity,
         strftime(l_shipdate, '%Y-%m-%d') AS shipdate, {_NOTE_SQL} AS note
  FROM lineitem)"""


@query("catalog_scan", f"""
WITH {_ROWS_SQL}
SELECT DISTINCT publish_ym, CAST(split_part(publish_ym, '_', 1) AS INTEGER) AS data_year,
       CAST(split_part(publish_ym, '_', 2) AS INTEGER) AS data_month, 'flag_' || flag || '.zip' AS file_name, 1 AS kind
FROM rows
UNION ALL SELECT '1995_3', 1995, 3, '統合.csv', 0""")
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Library scan: valid month folders only, archives and the merged CSV (metadata only)."""
    lst = zipcsv.library_listing(spark, library_root(spark, sf))
    return lst.select("publish_ym", "data_year", "data_month", "file_name", "kind")


# Bytes of one CSV line as written: cp932 takes two bytes per non-ASCII
# character used here, UTF-8 three.
_LINE_SQL = """orderkey || ',' || linenumber || ',' || quantity || ',' || shipdate || ','
   || CASE WHEN note LIKE '%,%' OR note LIKE '%"%' OR note LIKE '%' || chr(10) || '%'
           THEN '"' || replace(note, '"', '""') || '"' ELSE note END || chr(10)"""
_HEADER_BYTES = len(",".join(_COLUMNS)) + 1


@query("zip_first_csv", f"""
WITH {_ROWS_SQL},
lines AS (SELECT publish_ym, flag, {_LINE_SQL} AS line, linenumber FROM rows)
SELECT publish_ym, 'flag_' || flag || '.zip' AS file_name, 'data_' || flag || '.csv' AS member,
       CAST({_HEADER_BYTES} + sum(CASE WHEN flag = 'R' THEN strlen(line)
                     ELSE length(line) + length(regexp_replace(line, '[\\x00-\\x7F]', '', 'g')) END) AS BIGINT) AS uncompressed_size,
       CAST(count(*) + count_if(linenumber = '1') AS BIGINT) AS data_rows
FROM lines GROUP BY publish_ym, flag""")
def zip_first_csv(spark: SparkSession, sf: str) -> DataFrame:
    """First CSV member per archive, its uncompressed size and newline-rule row count."""
    z = _zips(spark, sf)
    firsts = zipcsv.first_csv_members(z.select("path", "length"))
    stats = zipcsv.compute_file_stats(z.select("path", "length"))
    return (z.join(firsts, "path").join(stats.select("path", "row_count"), "path")
            .select("publish_ym", "file_name", "member", "uncompressed_size", F.col("row_count").alias("data_rows")))


@query("archive_stats", f"""
WITH {_ROWS_SQL},
lines AS (SELECT publish_ym, flag, {_LINE_SQL} AS line, linenumber FROM rows)
SELECT publish_ym, 'flag_' || flag || '.zip' AS file_name,
       CAST(count(*) + count_if(linenumber = '1') AS BIGINT) AS row_count,
       CAST({_HEADER_BYTES} + sum(CASE WHEN flag = 'R' THEN strlen(line)
                     ELSE length(line) + length(regexp_replace(line, '[\\x00-\\x7F]', '', 'g')) END) AS BIGINT) AS display_size
FROM lines GROUP BY publish_ym, flag
UNION ALL SELECT '1995_3', '統合.csv', CAST(1 AS BIGINT), CAST(11 AS BIGINT)""")
def archive_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics job over every library file (newline-rule rows; display
    size = uncompressed member size for archives, on-disk size otherwise)."""
    lst = zipcsv.library_listing(spark, library_root(spark, sf))
    stats = zipcsv.compute_file_stats(lst.select("path", "length"))
    return lst.join(stats, "path").select("publish_ym", "file_name", "row_count", "display_size")


def _read_all(spark: SparkSession, sf: str, zips: DataFrame) -> DataFrame:
    meta = zips.select("path", "publish_ym", "file_name")
    merged, _ = zipcsv.read_zip_csvs(spark, zips.select("path", "length"), shared_scratch(spark, "stage"),
                                     annotate=meta, source_col=None)
    return merged


@query("zip_csv_read", f"WITH {_ROWS_SQL} SELECT *, 'flag_' || flag || '.zip' AS file_name FROM rows")
def zip_csv_read(spark: SparkSession, sf: str) -> DataFrame:
    """Every archive's CSV decoded (cp932 → shift_jis → utf-8) and read as strings."""
    r = _read_all(spark, sf, _zips(spark, sf))
    return r.withColumn("flag", F.regexp_extract("file_name", r"^flag_(.*)\.zip$", 1))


@query("merge_roundtrip", f"WITH {_ROWS_SQL} SELECT publish_ym, {', '.join(_COLUMNS)} FROM rows")
def merge_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Positional merge of all archives written as a month-partitioned dataset and read back."""
    dest = shared_scratch(spark, "merged")
    zipcsv.write_merged(_read_all(spark, sf, _zips(spark, sf)).drop("file_name"), dest)
    return spark.read.parquet(dest).select("publish_ym", *_COLUMNS)


@query("merge_export", f"WITH {_ROWS_SQL} SELECT {', '.join(_COLUMNS)} FROM rows")
def merge_export(spark: SparkSession, sf: str) -> DataFrame:
    """The merged cp932 CSV of all archives (ordered part files, one header),
    decoded and parsed back."""
    blocks = zipcsv.stage_archives(_zips(spark, sf).select("path", "length"), shared_scratch(spark, "stage"))
    dest = shared_scratch(spark, "export")
    zipcsv.export_merged_cp932(blocks, dest).write.mode("overwrite").parquet(dest + "/_parts")
    names = zipcsv.canonical_header(blocks)
    return zipcsv.read_cp932_export(spark.read.parquet(dest + "/_parts"), dest, names).select(*_COLUMNS)


# Fixed query parameters: selected targets, export month and file cap.
SELECTED_FLAGS = ["A", "R"]
EXPORT_YM, EXPORT_MAX_FILES = "1997_6", 2


@query("merge_selected", f"""WITH {_ROWS_SQL}
SELECT publish_ym, {', '.join(_COLUMNS)} FROM rows WHERE flag IN ({', '.join(f"'{x}'" for x in SELECTED_FLAGS)})""")
def merge_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Merge only the selected targets' archives of each month (semi join on ``label.zip``)."""
    sel = spark.createDataFrame([(f"flag_{x}.zip",) for x in SELECTED_FLAGS], "file_name string")
    lst = zipcsv.library_listing(spark, library_root(spark, sf))
    merged = zipcsv.merge_selected_archives(spark, lst, sel, shared_scratch(spark, "stage"),
                                            shared_scratch(spark, "merged-selected"))
    return merged.select("publish_ym", *_COLUMNS)


@query("merge_capped", f"""WITH {_ROWS_SQL}
SELECT publish_ym, {', '.join(_COLUMNS)} FROM rows
WHERE publish_ym = '{EXPORT_YM}' AND 'flag_' || flag || '.zip' IN (
  SELECT DISTINCT 'flag_' || flag || '.zip' AS f FROM rows WHERE publish_ym = '{EXPORT_YM}' ORDER BY f LIMIT {EXPORT_MAX_FILES})""")
def merge_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Export of one month: its archives by path, capped at ``max_files``, merged."""
    zips = zipcsv.month_archives(_zips(spark, sf), EXPORT_YM, EXPORT_MAX_FILES).filter("taken")
    return _read_all(spark, sf, zips).select("publish_ym", *_COLUMNS)


@query("merge_omitted", f"""WITH {_ROWS_SQL},
files AS (SELECT DISTINCT publish_ym, 'flag_' || flag || '.zip' AS file_name FROM rows WHERE publish_ym = '{EXPORT_YM}')
SELECT publish_ym, file_name, row_number() OVER (ORDER BY file_name) <= {EXPORT_MAX_FILES} AS taken FROM files""")
def merge_omitted(spark: SparkSession, sf: str) -> DataFrame:
    """What the capped export of a month takes and leaves out."""
    return zipcsv.month_archives(_zips(spark, sf), EXPORT_YM, EXPORT_MAX_FILES).select("publish_ym", "file_name", "taken")


@query("zip_extract", f"""
WITH {_ROWS_SQL},
lines AS (SELECT publish_ym, flag, {_LINE_SQL} AS line FROM rows),
data AS (SELECT publish_ym, 'flag_' || flag AS stem, 'data_' || flag || '.csv' AS member,
                CAST({_HEADER_BYTES} + sum(CASE WHEN flag = 'R' THEN strlen(line)
                     ELSE length(line) + length(regexp_replace(line, '[\\x00-\\x7F]', '', 'g')) END) AS BIGINT) AS size
         FROM lines GROUP BY ALL),
arch AS (SELECT DISTINCT publish_ym, stem FROM data)
SELECT * FROM data
UNION ALL SELECT publish_ym, stem, 'readme.txt', CAST(7 AS BIGINT) FROM arch
UNION ALL SELECT publish_ym, stem, 'extra.csv', CAST(4 AS BIGINT) FROM arch""")
def zip_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Extract all members of every archive under ``<root>/<month>/<stem>/`` (replacing)."""
    z = _zips(spark, sf)
    out = zipcsv.extract_archives(z.select("path", "length"), shared_scratch(spark, "extracted"))
    return (out.join(z.select("path", "publish_ym", "file_name"), "path")
            .select("publish_ym", F.regexp_replace("file_name", r"\.zip$", "").alias("stem"), "member", "size"))


@query("directory_size", f"""
WITH {_ROWS_SQL},
lines AS (SELECT publish_ym, flag, {_LINE_SQL} AS line FROM rows),
data AS (SELECT publish_ym, flag,
                CAST({_HEADER_BYTES} + sum(CASE WHEN flag = 'R' THEN strlen(line)
                     ELSE length(line) + length(regexp_replace(line, '[\\x00-\\x7F]', '', 'g')) END) AS BIGINT) AS size
         FROM lines GROUP BY ALL)
SELECT coalesce(publish_ym, '*') AS folder, CAST(3 * count(*) AS BIGINT) AS files,
       CAST(sum(size + 7 + 4) AS BIGINT) AS bytes FROM data GROUP BY ROLLUP (publish_ym)""")
def directory_size(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes on disk of the extracted archives, per month folder and in total, from a listing."""
    root = shared_scratch(spark, "extracted")
    out = zipcsv.extract_archives(_zips(spark, sf).select("path", "length"), root)
    out.write.format("noop").mode("overwrite").save()  # runs the extraction
    month = F.nullif(F.regexp_extract("path", r"/(\d{4}_\d{1,2})/[^/]+/[^/]+$", 1), F.lit(""))
    return zipcsv.directory_sizes(zipcsv.list_files(spark, root), month)


@query("bundle_by_month", f"""
WITH {_ROWS_SQL}, f AS (SELECT DISTINCT publish_ym, 'flag_' || flag || '.zip' AS file_name FROM rows)
SELECT publish_ym, CAST(count(*) AS INTEGER) AS n_members, string_agg(file_name, ',' ORDER BY file_name) AS members
FROM f GROUP BY publish_ym""")
def bundle_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """One bundle archive per month holding its region ZIPs, sorted by name."""
    lst = zipcsv.library_listing(spark, library_root(spark, sf))
    b = zipcsv.bundle_months(lst, shared_scratch(spark, "bundles"))
    return b.select("publish_ym", "n_members", "members")


def _fixture_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    r = archive_rows(spark, sf).filter(F.col("publish_ym").endswith("_9")).select("publish_ym", "flag").distinct()
    return r.select("publish_ym", F.concat(F.lit("c_"), F.lower("flag")).alias("target_code"),
                    F.concat(F.lit("FLAG "), F.col("flag")).alias("display_name"),
                    F.concat(F.lit("old/"), F.col("publish_ym"), F.lit("/flag_"), F.col("flag"), F.lit(".zip")).alias("file_path"),
                    F.lit("c").alias("sha256"), F.lit(None).cast("string").alias("source_url"),
                    F.lit(None).cast("string").alias("downloaded_at"), F.lit("ok").alias("status"))


def _fixture_publications(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    return li.groupBy(_ym("l_shipdate").alias("publish_ym")).agg(
        F.when(F.count_if(F.col("l_linestatus") == "O") > 0, F.lit("partial")).otherwise(F.lit("complete")).alias("status"))


@query("library_view", f"""
WITH {_ROWS_SQL},
pubs AS (SELECT publish_ym, CASE WHEN count_if(flag IS NOT NULL AND note LIKE '%O%') > 0 THEN 'partial' ELSE 'complete' END AS st
         FROM rows GROUP BY publish_ym),
files AS (SELECT DISTINCT publish_ym, 'flag_' || flag || '.zip' AS file_name, 1 AS kind, flag FROM rows WHERE publish_ym <> '1996_6'
          UNION ALL SELECT '1995_3', '統合.csv', 0, NULL),
v AS (
  SELECT f.publish_ym, f.file_name, f.kind,
         CAST(split_part(f.publish_ym, '_', 1) AS INTEGER) AS y, CAST(split_part(f.publish_ym, '_', 2) AS INTEGER) AS m,
         CASE WHEN kind = 0 THEN '統合CSV' WHEN ends_with(f.publish_ym, '_3') THEN 'Flag ' || flag || ' ' || f.publish_ym
              WHEN ends_with(f.publish_ym, '_9') THEN 'FLAG ' || flag ELSE 'flag_' || flag END AS display_name,
         CASE WHEN kind = 0 THEN 'merged' WHEN ends_with(f.publish_ym, '_3') THEN lower(flag)
              WHEN ends_with(f.publish_ym, '_9') THEN 'c_' || lower(flag) END AS target_code,
         CASE WHEN kind = 0 THEN NULL WHEN ends_with(f.publish_ym, '_3') THEN 'm'
              WHEN ends_with(f.publish_ym, '_9') THEN 'c' END AS sha256,
         CASE WHEN kind = 1 AND ends_with(f.publish_ym, '_9') THEN 'ok' END AS status,
         CASE WHEN kind = 0 THEN 'merged' WHEN ends_with(f.publish_ym, '_3') THEN 'manifest'
              WHEN ends_with(f.publish_ym, '_9') THEN 'catalogue' ELSE 'disk' END AS source_kind,
         p.st
  FROM files f LEFT JOIN pubs p ON f.publish_ym = p.publish_ym),
mr AS (SELECT DISTINCT y, m FROM v)
SELECT publish_ym, file_name, kind, display_name, target_code, sha256, status, source_kind, true AS needs_stats,
       CAST(y AS VARCHAR) || '年' || CAST(m AS VARCHAR) || '月分 (' || publish_ym || ')'
         || CASE WHEN st IS NULL THEN '' ELSE ' [' || st || ']' END AS month_label,
       (SELECT count(*) FROM mr WHERE mr.y > v.y OR (mr.y = v.y AND mr.m > v.m)) + 1 AS month_rank,
       row_number() OVER (PARTITION BY publish_ym ORDER BY display_name) AS file_rank
FROM v""")
def library_view(spark: SparkSession, sf: str) -> DataFrame:
    """The library view sorted by name: manifest, catalogue or file stem per file,
    month status labels, and the folder with a broken manifest left out."""
    v = scan_library(spark, library_root(spark, sf), catalogue=_fixture_catalogue(spark, sf),
                     publications=_fixture_publications(spark, sf), sort="name")
    return v.select("publish_ym", "file_name", "kind", "display_name", "target_code", "sha256", "status",
                    "source_kind", "needs_stats", "month_label", "month_rank", "file_rank")


# What the record of an archive says: its true hash (A, R of odd years), a hash of other bytes (N of even years),
# another size (N of odd years), no hash (R of even years).
@query("landed_reconcile", f"""
WITH {_ROWS_SQL},
archives AS (SELECT DISTINCT publish_ym, flag, CAST(split_part(publish_ym, '_', 1) AS INTEGER) % 2 AS odd FROM rows)
SELECT publish_ym || '/flag_' || flag AS target,
       CASE WHEN flag = 'R' AND odd = 0 THEN 'new' WHEN flag = 'A' OR flag = 'R' THEN 'skip' ELSE 'changed' END AS action
FROM archives
UNION ALL SELECT DISTINCT publish_ym || '/flag_none', 'missing' FROM archives""")
def landed_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Skip or fetch for each archive of the library, from its record and the landed file's bytes (hashed only where sizes agree)."""
    stem = F.regexp_replace("file_name", "[.]zip$", "")
    landed = _zips(spark, sf).select(F.concat_ws("/", "publish_ym", stem).alias("target"), "path", "length", "data_year", stem.alias("stem"))
    truth = zipcsv.file_hashes(landed).select("path", "sha256")
    other = F.sha2("sha256", 256)
    none = (F.col("stem") == "flag_R") & (F.col("data_year") % 2 == 0)
    sha = F.when(none, F.lit(None)).when((F.col("stem") == "flag_N") & (F.col("data_year") % 2 == 0), other).otherwise(F.col("sha256"))
    size = F.col("length") + F.when((F.col("stem") == "flag_N") & (F.col("data_year") % 2 == 1), 1).otherwise(0)
    recorded = landed.join(truth, "path").select("target", sha.alias("sha256"), size.alias("size"))
    absent = landed.select(F.regexp_replace("target", "/flag_.*$", "/flag_none").alias("target")).distinct()
    return zipcsv.reconcile_files(landed.select("target").unionByName(absent), recorded, landed)


# Fixed query parameter: records shown of each archive.
HEAD_RECORDS = 20


@query("csv_head", f"""
WITH {_ROWS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY publish_ym, flag ORDER BY {', '.join(_COLUMNS)}) - 1 AS pos FROM rows)
SELECT publish_ym, 'flag_' || flag || '.zip' AS file_name, 'data_' || flag || '.csv' AS member,
       CASE WHEN flag = 'R' THEN 'utf-8' ELSE 'cp932' END AS encoding, CAST(pos AS INTEGER) AS pos, {', '.join(_COLUMNS)}
FROM n WHERE pos < {HEAD_RECORDS}""")
def csv_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first records of every archive's CSV, as a preview shows them; only the heads are inflated."""
    z = _zips(spark, sf)
    heads = zipcsv.csv_head(z.select("path"), HEAD_RECORDS).join(z.select("path", "publish_ym", "file_name"), "path")
    r = heads.select("publish_ym", "file_name", "member", "encoding", F.posexplode("records").alias("pos", "_f"))
    return r.select("publish_ym", "file_name", "member", "encoding", "pos", *[F.get("_f", F.lit(i)).alias(c) for i, c in enumerate(_COLUMNS)])


@query("library_view_stats", f"""
WITH {_ROWS_SQL},
files AS (SELECT publish_ym, 'flag_' || flag || '.zip' AS file_name, count(*) + count_if(linenumber = '1') AS row_count
          FROM rows WHERE publish_ym <> '{BROKEN_MANIFEST_YM}' GROUP BY publish_ym, flag
          UNION ALL SELECT '1995_3', '統合.csv', 1)
SELECT publish_ym, file_name, CAST(row_count AS BIGINT) AS row_count, false AS needs_stats FROM files""")
def library_view_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The library view with each file's row count, on a statistics table kept beside the library: a further call opens no archive."""
    root = library_root(spark, sf)
    v = scan_library_cached(spark, root, root.rstrip("/") + "-statistics", catalogue=_fixture_catalogue(spark, sf),
                            publications=_fixture_publications(spark, sf), sort="name")
    return v.select("publish_ym", "file_name", "row_count", "needs_stats")
