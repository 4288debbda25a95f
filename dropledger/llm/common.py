"""Helpers shared by the operators: written tables, gapless numbering, text pieces."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.session import ensure_checkpoint_dir, prepare, read_table

__all__ = ["materialise", "number_within", "prepare", "read_table", "scratch_uri", "stored_order", "text_or_empty"]

#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\f\r"


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The table survives lost executors, and later stages that use it several
    times don't compute it again.
    """
    spark = df.sparkSession
    path = scratch_uri(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def stored_order(table: DataFrame) -> Column | None:
    """The order in which the rows of a written Parquet table lie in its files; None for any other frame.

    Writers number their files, and lengths come first, so that file 100000
    follows file 99999.
    """
    order = F.concat_ws(
        "/", F.lpad(F.length("_metadata.file_name").cast("string"), 4, "0"), "_metadata.file_name",
        F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
    try:
        table.select(order)
    except AnalysisException:
        return None
    return order


def number_within(rows: DataFrame, by: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Add ``out``: 0, 1, 2 … without gaps within each ``by`` group.

    Rows of a group are dealt to ``buckets`` buckets by a hash of ``order``;
    a row's number is its rank in its bucket plus the counts of the buckets
    before, so that one group never meets in one task.  ``by`` columns must
    not be null.  ``rows`` is read twice: pass a written table.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        rows.withColumn("_rank", rank).join(starts, [*by, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_before")
    )
