"""Landing-folder refresh: pick up new and changed files by (size, mtime).

The file stream source never re-emits a path it has seen, so a file that
changed in place is found by diffing each listing against a state table
keyed by path.  Hand-dropped archives need no manifest: every listed file
is accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dropledger.sources.storage import open_store


# Fixed schema of Spark's binaryFile source (a stream must be given its schema).
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landing_diff(listing: DataFrame, state: DataFrame, path: str = "path",
                 size: str = "length", mtime: str = "mtime") -> DataFrame:
    """(path, size, mtime, change) with change ∈ new / changed / unchanged."""
    s = state.select(F.col(path), F.col(size).alias("_s"), F.col(mtime).alias("_m"), F.lit(True).alias("_known"))
    j = listing.select(path, size, mtime).join(s, path, "left")
    change = (F.when(F.col("_known").isNull(), F.lit("new"))
              .when((F.col(size) != F.col("_s")) | (F.col(mtime) != F.col("_m")), F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return j.select(path, size, mtime, change.alias("change"))


def fold_landing(state: DataFrame, diff: DataFrame, path: str = "path") -> DataFrame:
    """New state: new and changed files replace their rows; unchanged ones stay."""
    moved = diff.filter(F.col("change") != "unchanged").drop("change")
    return state.join(moved.select(path), path, "left_anti").unionByName(moved.select(*state.columns))


STATE_SCHEMA = "path string, length long, mtime timestamp"


def landing_state(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """Latest (length, mtime) of every path over the state's versions (those below ``before``).

    A version holds only what changed.  No state folder yet means no rows; any
    other failure to read it is raised, never taken for an empty state.
    """
    try:
        versions = spark.read.schema(STATE_SCHEMA + ", v long").parquet(state_dir)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMA)
    if before is not None:
        versions = versions.filter(F.col("v") < before)  # a repeated batch doesn't see its own version
    return versions.groupBy("path").agg(F.max_by(F.struct("length", "mtime"), "v").alias("_last")).select(
        "path", "_last.length", "_last.mtime")


def landing_stream(spark: SparkSession, landing_dir: str, state_dir: str, checkpoint_dir: str,
                   glob: str = "*.zip"):
    """Start an ``availableNow`` stream over the landing folder; each micro-batch
    is diffed against the state, and what is new or changed becomes a version
    of it.  Files that change in place are found by diffing a listing
    (:func:`landing_diff`), since a file stream never emits a path twice.

    Returns the ``StreamingQuery`` (call ``awaitTermination()``).
    """
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
              .option("recursiveFileLookup", "true").load(landing_dir)
              .select("path", "length", F.col("modificationTime").alias("mtime")))

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = landing_state(batch.sparkSession, state_dir, before=batch_id)
        moved = landing_diff(batch, state).filter(F.col("change") != "unchanged").drop("change")
        moved.write.mode("overwrite").parquet(f"{state_dir}/v={batch_id}")

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


# --- changes of a folder as a stream ------------------------------------------------

CHANGE_SCHEMA = "path string, length long, mtime long, change string"


def change_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """All changes found so far, with the refresh ``v`` that found them (no folder yet: no rows)."""
    try:
        return spark.read.schema(CHANGE_SCHEMA + ", v long").parquet(log_dir)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHANGE_SCHEMA + ", v long")


def known_files(log: DataFrame) -> DataFrame:
    """(path, length, mtime) of the files that the log holds: each path's last change, unless it is a deletion."""
    last = log.groupBy("path").agg(F.max_by(F.struct("length", "mtime", "change"), "v").alias("_last"))
    return last.where("_last.change <> 'deleted'").select("path", "_last.length", "_last.mtime")


def listing_changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, length, mtime, change) of files that are new, changed (size or time differ, nulls being equal) or deleted since.

    A path listed twice counts as its latest entry; a null path is left out.
    """
    now = listing.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "length")).alias("_f"))
    now = now.select("path", F.col("_f.length").cast("long").alias("length"), F.col("_f.mtime").alias("mtime"), F.lit(True).alias("_here"))
    was = known.select("path", F.col("length").alias("_length"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_was"))
    j = now.join(was, "path", "full_outer")
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    change = (F.when(F.col("_was").isNull(), "new").when(F.col("_here").isNull(), "deleted").when(~same, "changed"))
    gone = F.col("_here").isNull()
    return j.select("path", F.when(gone, F.col("_length")).otherwise(F.col("length")).alias("length"),
                    F.when(gone, F.col("_mtime")).otherwise(F.col("mtime")).alias("mtime"), change.alias("change")).where("change is not null")


def refresh_changes(listing: DataFrame, log_dir: str, version: int) -> None:
    """Compare a listing (path, length, mtime in milliseconds) with the log and add what differs as refresh ``version`` (1, 2, …).

    A refresh that is in the log already stays as it is, so a repeated call
    adds nothing and readers of the log see the same rows again.  Spark's
    writer commits the files, and an attempt that failed before its commit is
    written anew.
    """
    from pyarrow import fs

    store, path = open_store(f"{log_dir}/v={version}/_SUCCESS")
    if store.get_file_info(path).type != fs.FileType.NotFound:
        return
    known = known_files(change_log(listing.sparkSession, log_dir).where(F.col("v") < version))
    listing_changes(listing, known).write.mode("overwrite").parquet(f"{log_dir}/v={version}")


def folder_listing(spark: SparkSession, folder: str, glob: str = "*.zip") -> DataFrame:
    """A folder tree's files as :func:`refresh_changes` takes them (metadata only)."""
    found = (spark.read.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(folder))
    return found.select("path", "length", F.unix_millis("modificationTime").alias("mtime"))


def changes_stream(spark: SparkSession, log_dir: str) -> DataFrame:
    """The change log as a streaming source: every change of every refresh once, the same after a restart.

    A file stream over the landing folder never shows a path twice; here each
    refresh is a set of new files, so changed and deleted files arrive too.
    """
    return spark.readStream.schema(CHANGE_SCHEMA + ", v long").parquet(log_dir)
