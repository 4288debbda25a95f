"""Gap detection against a generated month spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.functions.calendar import month_key, strict_month_key


def month_spine(spark: SparkSession, start_key: str, end_key: str) -> DataFrame:
    """Every month of the inclusive ``YYYY_M`` range as (publish_ym, data_year, data_month).

    Generated from the two parameters (``sequence`` + ``explode``), so its
    size is bounded by the requested range, not by the data.  An inverted
    range is empty; an invalid key is an error.
    """
    ends = spark.range(1).select(strict_month_key(F.lit(start_key)).alias("s"),
                                 strict_month_key(F.lit(end_key)).alias("e"))
    first, last = (F.make_date(f"{x}.year", f"{x}.month", F.lit(1)) for x in "se")
    d = ends.select(first.alias("first"), last.alias("last")).select(
        "last", F.explode(F.sequence("first", F.greatest("first", "last"), F.expr("INTERVAL 1 MONTH"))).alias("d")
    ).filter(F.col("d") <= F.col("last"))  # an inverted range has no months
    return d.select(month_key(F.year("d"), F.month("d")).alias("publish_ym"),
                    F.year("d").alias("data_year"), F.month("d").alias("data_month"))


def missing_months(spark: SparkSession, start_key: str, end_key: str, complete_keys: DataFrame,
                   key: str = "publish_ym") -> DataFrame:
    """Months of the range without a complete publication (anti join on the raw key).

    The key is compared as the unpadded string, so a padded ``2026_03`` in
    the catalogue does not close the ``2026_3`` gap.
    """
    spine = month_spine(spark, start_key, end_key)
    done = complete_keys.select(F.col(key).alias("publish_ym"))
    return spine.join(done, "publish_ym", "left_anti").orderBy("data_year", "data_month")
