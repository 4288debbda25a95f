"""The library view: one scan from month folders to labelled, ordered file rows.

Listing (metadata only) → per-folder manifest check (a folder whose
manifest cannot be read or parsed is dropped, as the reference drops a
folder that raises while it is scanned) → manifest ⟕ catalogue precedence
per file → memoised statistics → month status → library order and labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.functions.text import basename, file_label, month_label, stem
from dropledger.operators.changelog import fold_state
from dropledger.operators.library import tree_ranks
from dropledger.operators.reconcile import memo_lookup, precedence_merge
from dropledger.operators.statcache import read_entries, scan
from dropledger.session import shared_scratch, written
from dropledger.sources.jsondocs import MANIFEST_FILE_NAME, MANIFEST_SCHEMA, _read_text_fn
from dropledger.sources.zipcsv import MERGED_CSV_DISPLAY, compute_file_stats, library_listing

# Fixed value: target code shown for the merged CSV.
MERGED_CODE = "merged"
FIELDS = ["display_name", "target_code", "sha256", "source_url", "downloaded_at"]


def _folder(path_col: str = "path"):
    return F.regexp_replace(F.col(path_col), r"/[^/]+$", "")


def scan_library(spark: SparkSession, root: str, catalogue: DataFrame | None = None,
                 publications: DataFrame | None = None, cache: DataFrame | None = None,
                 sort: str = "date_desc", listing: DataFrame | None = None) -> DataFrame:
    """Library rows with display fields, statistics, status, order and labels.

    ``catalogue``: (publish_ym, target_code, display_name, file_path, sha256,
    source_url, downloaded_at, status); ``publications``: (publish_ym,
    status); ``cache``: (path, length, mtime, row_count, uncompressed_size).
    All optional.  ``sort``: ``date_desc`` | ``date_asc`` | ``name``.
    ``listing`` is what ``library_listing`` gave, if the caller has it already.
    """
    lst = (library_listing(spark, root) if listing is None else listing).withColumn("folder", _folder())
    folders = lst.select("folder").distinct()
    # One small row per folder, read by Python tasks once and kept as a table
    # (it feeds both the folder check and the entries).
    texts_path = shared_scratch(spark, "manifest-texts")
    folders.mapInPandas(_read_text_fn(MANIFEST_FILE_NAME), "folder string, text string") \
        .write.mode("overwrite").parquet(texts_path)
    texts = spark.read.parquet(texts_path)
    parsed = texts.select("folder", F.from_json("text", MANIFEST_SCHEMA).alias("m"))
    bad = parsed.filter(F.col("m.publish_ym").isNull()).select("folder")
    lst = lst.join(bad, "folder", "left_anti")

    key = F.concat(F.col("publish_ym"), F.lit("/"), F.col("file_name"))
    entries = (parsed.filter(F.col("m.publish_ym").isNotNull())
               .select("folder", F.posexplode_outer("m.files").alias("pos", "f"))
               .filter(F.col("f").isNotNull())
               .select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("publish_ym"),
                       F.col("f.filename").alias("file_name"), "pos",
                       *[F.col(f"f.{c}").alias(c) for c in FIELDS]))
    # A dict by file name: the last entry of a duplicated name wins.
    manifest = fold_state(entries, ["publish_ym", "file_name"], "pos", last=FIELDS).withColumn("_k", key).drop(
        "publish_ym", "file_name")
    if catalogue is None:
        catalogue = spark.createDataFrame([], "publish_ym string, target_code string, display_name string, "
                                              "file_path string, sha256 string, source_url string, "
                                              "downloaded_at string, status string")
    cat = catalogue.withColumn("file_name", basename("file_path"))
    # Several catalogue rows can share a base name: the last in code order wins.
    cat = fold_state(cat, ["publish_ym", "file_name"], "target_code", last=FIELDS + ["status"]) \
        .withColumn("_k", key).drop("publish_ym", "file_name")

    zips = lst.filter(F.col("kind") == 1).withColumn("_k", key)
    merged_zip = precedence_merge(zips, manifest, cat, "_k", FIELDS, stem(F.col("file_name")))
    csvs = lst.filter(F.col("kind") == 0).select(
        *lst.columns, F.lit(None).cast("string").alias("_k"),
        F.lit(MERGED_CSV_DISPLAY).alias("display_name"), F.lit(MERGED_CODE).alias("target_code"),
        *[F.lit(None).cast("string").alias(c) for c in FIELDS[2:]],
        F.lit("merged").alias("source_kind"), F.lit(None).cast("string").alias("status"))
    files = merged_zip.unionByName(csvs).drop("_k")

    files = files.withColumn("mtime", F.unix_micros(F.col("modificationTime")))
    if cache is None:
        cache = spark.createDataFrame([], "path string, length long, mtime long, row_count long, "
                                          "uncompressed_size long")
    files = memo_lookup(files, cache).withColumn("needs_stats", F.col("row_count").isNull())

    if publications is not None:
        files = files.join(publications.select("publish_ym", F.col("status").alias("publication_status")),
                           "publish_ym", "left")
    else:
        files = files.withColumn("publication_status", F.lit(None).cast("string"))

    ranked = tree_ranks(files.withColumnRenamed("data_year", "year").withColumnRenamed("data_month", "month"))
    mr = "month_rank_asc" if sort == "date_asc" else "month_rank_desc"
    fr = "file_rank_name" if sort == "name" else "file_rank_date"
    return ranked.select(
        "publish_ym", "year", "month", "file_name", "path", "kind", *FIELDS, "status", "source_kind",
        "display_size", "row_count", "needs_stats", "publication_status",
        F.col(mr).alias("month_rank"), F.col(fr).alias("file_rank"),
        file_label(F.col("display_name"), F.col("display_size"), F.col("row_count")).alias("file_label"),
        month_label(F.col("year"), F.col("month"), F.col("publish_ym"), F.col("publication_status")).alias("month_label"))


def scan_library_cached(spark: SparkSession, root: str, cache_root: str, **how) -> DataFrame:
    """:func:`scan_library` on the statistics table at ``cache_root``, which it brings up to date first.

    The folder tree is listed once.  Files without an entry for their size and
    time are measured and added, entries of files that have gone are dropped,
    and a scan in which nothing changed opens no archive.
    """
    lst = written(library_listing(spark, root), "listing")
    files = lst.select("path", "length", F.unix_micros("modificationTime").alias("mtime"))
    scan(files, cache_root, lambda misses: compute_file_stats(misses).withColumnRenamed("display_size", "uncompressed_size"))
    return scan_library(spark, root, cache=read_entries(spark, cache_root), listing=lst, **how)
