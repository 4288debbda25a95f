"""The persisted statistics cache over the landed files of ``documents``.

Seeds: an entry for each labelled document.  Toxic ones name a file that is
gone, those of quality 0 have a malformed key (no mtime), and every seventh
document's entry was taken at another size.  Files in German are listed but
not in the valid set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.operators.outcomes import newline_rows
from dropledger.operators.statcache import put_entries, read_entries, scan
from dropledger.plans.bindings import sql_with, t
from dropledger.plans.library_plans import _ROWS_SQL, LISTING_SQL, listing
from dropledger.plans.registry import query
from dropledger.session import shared_uri

SEED_SQL = f"""seed AS (
  SELECT CASE WHEN toxic = 1 THEN replace(path, '/doc_', '/old_') ELSE path END AS path,
         length + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS length,
         CASE WHEN quality = 0 AND toxic = 0 THEN NULL ELSE mtime END AS mtime, {_ROWS_SQL} AS row_count,
         CASE WHEN quality = 1 THEN CAST(strlen(text) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS uncompressed_size
  FROM listing JOIN labels USING (doc_id)),
first AS (
  SELECT l.path, l.length, l.mtime, l.lang <> 'de' AS valid, s.path IS NOT NULL AS hit, {_ROWS_SQL} AS row_count,
         CAST(strlen(text) AS BIGINT) AS bytes, s.uncompressed_size AS known
  FROM listing l LEFT JOIN seed s ON l.path = s.path AND l.length = s.length AND l.mtime = s.mtime)"""


def _statistics(files: DataFrame):
    """Statistics job for cache misses: only their texts are read and measured."""
    def run(misses: DataFrame) -> DataFrame:
        return files.join(misses.select("path"), "path", "left_semi").select(
            "path", newline_rows("text").alias("row_count"), F.octet_length("text").cast("long").alias("uncompressed_size"))
    return run


def _cycle(spark: SparkSession, sf: str):
    """A seeded table, scanned twice; (root, first scan, second scan)."""
    root = shared_uri(spark, "stat-cache")
    files = listing(spark, sf)
    seeds = files.select("doc_id", "path", "length", "mtime", newline_rows("text").alias("row_count"),
                         F.octet_length("text").cast("long").alias("bytes")).join(t(spark, sf, "labels"), "doc_id")
    put_entries(seeds.select(
        F.when(F.col("toxic") == 1, F.regexp_replace("path", "/doc_", "/old_")).otherwise(F.col("path")).alias("path"),
        (F.col("length") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("length"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(None)).otherwise(F.col("mtime")).alias("mtime"),
        "row_count", F.when(F.col("quality") == 1, F.col("bytes")).otherwise(F.lit(0).cast("long")).alias("uncompressed_size")), root)
    listed, valid = files.select("path", "length", "mtime"), files.where(F.col("lang") != "de").select("path")
    return root, *(scan(listed, root, _statistics(files), valid) for _ in range(2))


@query("stats_cache_cycle", sql_with(LISTING_SQL, SEED_SQL) + """
SELECT 1 AS scan, path, hit AS cache_hit, row_count,
       CASE WHEN hit THEN coalesce(nullif(known, 0), length) ELSE coalesce(nullif(bytes, 0), length) END AS display_size FROM first
UNION ALL
SELECT 2, path, valid, row_count,
       CASE WHEN hit AND valid THEN coalesce(nullif(known, 0), length) ELSE coalesce(nullif(bytes, 0), length) END FROM first""")
def stats_cache_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Two scans over a kept table: misses are measured and added, stale entries go, the second scan hits."""
    _, first, second = _cycle(spark, sf)
    both = [s.files.select(F.lit(n).alias("scan"), "path", "cache_hit", "row_count", "display_size")
            for n, s in ((1, first), (2, second))]
    return both[0].unionByName(both[1])


@query("stats_cache_state", sql_with(LISTING_SQL, SEED_SQL) + """
SELECT s.* FROM seed s WHERE mtime IS NOT NULL AND path IN (SELECT path FROM first WHERE valid)
UNION ALL
SELECT path, length, mtime, row_count, bytes FROM first WHERE valid AND NOT hit""")
def stats_cache_state(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that the table holds after both scans."""
    return read_entries(spark, _cycle(spark, sf)[0])
