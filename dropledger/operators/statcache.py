"""File statistics kept between scans: a table in hash buckets of which a scan rewrites only what it touches.

An entry is keyed by (path, length, mtime), so statistics of a file that has
changed are never taken for its own.  A scan is one pass: listing and entries
meet once, by path; what a listed file has is a hit, what it lacks is computed
and added, and entries that are malformed or whose file is gone are dropped.
Buckets in which nothing was added or dropped keep their files.  A rewritten
bucket is written whole, first beside the table, then in its place (dynamic
partition overwrite), with a marker row so that a bucket that lost all its
entries is replaced too; a scan that dies in between can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.session import written

BUCKETS = 64
ENTRY = "path string, length long, mtime long, row_count long, uncompressed_size long"
_STORED = f"{ENTRY}, marker boolean, bucket int"
_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


@dataclass
class Scan:
    """Result of one scan: ``files`` (path, length, mtime, display_size, row_count, cache_hit) and what it did."""

    files: DataFrame
    hits: int
    added: int
    evicted: int
    touched: int


def _bucket(path: str, buckets: int):
    return F.pmod(F.xxhash64(F.coalesce(path, F.lit(""))), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the table, markers included; a table that isn't there yet is empty."""
    try:
        return spark.read.schema(_STORED).parquet(root)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """All entries of the table."""
    return _stored(spark, root).where("not marker").select(_COLUMNS)


def _put(entries: DataFrame, touched: DataFrame, root: str) -> None:
    """Replace the ``touched`` buckets by ``entries`` (with their bucket), all of which lie in them."""
    marks = touched.select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRY.split(", ")],
                           F.lit(True).alias("marker"), "bucket")
    rows = entries.select(*_COLUMNS, F.lit(False).alias("marker"), "bucket").unionByName(marks)
    rows = written(rows.repartition("bucket"), "stat-entries")  # what is read below isn't what is replaced
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)


def put_entries(entries: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Upsert: ``entries`` replace those of the same key; only their buckets are rewritten."""
    fresh = written(entries.select(_COLUMNS).withColumn("bucket", _bucket("path", buckets)), "stat-fresh")
    touched = fresh.select("bucket").distinct()
    key = ["path", "length", "mtime"]
    same = F.lit(True)
    old = _stored(entries.sparkSession, root).where("not marker").join(touched, "bucket", "left_semi")
    for c in key:  # null-safe: a malformed entry is replaced like any other
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}"))
    kept = old.alias("o").join(fresh.select(key).alias("f"), same, "left_anti").select(*_COLUMNS, "bucket")
    _put(kept.unionByName(fresh.select(*_COLUMNS, "bucket")), touched, root)


def scan(listing: DataFrame, root: str, statistics: Callable[[DataFrame], DataFrame], valid: DataFrame | None = None,
         buckets: int = BUCKETS) -> Scan:
    """One scan of ``listing`` (path, length, mtime) against the table at ``root``.

    ``statistics`` gets the listed files (path, length, mtime) without an entry
    that has a row count, and returns (path, row_count, uncompressed_size).
    Entries survive if key and path are well formed and their path is listed
    and (if given) in ``valid`` (path).  Listed files outside ``valid`` are
    measured for the result but not kept.
    """
    spark = listing.sparkSession
    files = listing.select("path", F.struct("length", "mtime").alias("file"), F.lit(None).cast("struct<length:long,mtime:long,row_count:long,uncompressed_size:long>").alias("entry"), F.lit(None).cast("boolean").alias("ok"))
    entries = _stored(spark, root).where("not marker").select(
        "path", F.lit(None).cast("struct<length:long,mtime:long>").alias("file"),
        F.struct("length", "mtime", "row_count", "uncompressed_size").alias("entry"), F.lit(None).cast("boolean").alias("ok"))
    allowed = (listing if valid is None else valid).select(
        "path", F.lit(None).cast("struct<length:long,mtime:long>").alias("file"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"),
        F.lit(True).alias("ok"))
    # A path has a few entries at most, one for each of its versions since it was last evicted.
    met = files.unionByName(entries).unionByName(allowed).groupBy("path").agg(
        F.max("file").alias("file"), F.collect_list("entry").alias("entries"), F.max("ok").alias("ok"))
    alive = F.col("path").isNotNull() & F.col("file").isNotNull() & F.coalesce("ok", F.lit(False))
    met = met.withColumn("alive", alive).withColumn("kept", F.expr(
        "if(alive, filter(entries, e -> e.length is not null and e.mtime is not null), slice(entries, 1, 0))"
    )).withColumn("hit", F.expr("get(filter(entries, e -> e.length = file.length and e.mtime = file.mtime and e.row_count is not null), 0)"))
    met = written(met.select("path", "file", "alive", "kept", "hit", F.size("entries").alias("n"), _bucket("path", buckets).alias("bucket")), "stat-scan")
    listed = met.where("file is not null")
    computed = written(statistics(listed.where("hit is null").select("path", "file.*")).select("path", "row_count", "uncompressed_size"), "stat-computed")
    fresh = listed.where("hit is null").select("path", "file", "alive", "bucket").join(computed, "path")
    added = fresh.where("alive").select("path", "file.*", "row_count", "uncompressed_size", "bucket")
    touched = written(
        met.where("n > size(kept)").select("bucket").unionByName(added.select("bucket")).distinct(), "stat-touched")
    counts = met.agg(F.count_if(F.col("hit").isNotNull() & F.col("file").isNotNull()), F.sum(F.col("n") - F.size("kept"))).first()
    n_added, n_touched = added.count(), touched.count()
    if n_touched:
        old = met.join(touched, "bucket", "left_semi").select("path", "bucket", F.explode("kept").alias("e")).select("path", "e.*", "bucket")
        current = added.select("path", "length", "mtime")
        _put(old.join(current, ["path", "length", "mtime"], "left_anti").unionByName(added), touched, root)
    size = F.coalesce(F.nullif("uncompressed_size", F.lit(0)), "length")
    hits = listed.where("hit is not null").select(
        "path", "file.*", "hit.row_count", "hit.uncompressed_size", F.lit(True).alias("cache_hit"))
    misses = listed.where("hit is null").select("path", "file.*").join(computed, "path", "left").withColumn("cache_hit", F.lit(False))
    view = hits.unionByName(misses).select("path", "length", "mtime", size.alias("display_size"), "row_count", "cache_hit")
    return Scan(view, counts[0], n_added, int(counts[1] or 0), n_touched)
