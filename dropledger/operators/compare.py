"""Comparison of two months, record by record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_months(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What became of the records of ``before`` in ``after``: (keys, change, before, after, n).

    Records are matched on ``keys``; a null is a key like any other.  Of a key
    with several records, equal ones are paired first (``same``); what is left
    on both sides is paired in the order of the values (``changed``), and the
    longer side's rest is ``removed`` or ``added``.  ``before`` and ``after``
    are structs of the values, ``n`` counts records that share a line.

    Equal records are folded to one row with a count where they are read.
    Pairing is a merge of runs: a key's rows on each side lie one behind the
    other on a line of counts, and the cuts of both lines make the pairs, so a
    key with many records costs as many rows as it has different ones, not
    their product.
    """
    keys, values = list(keys), list(values)
    record = F.struct(*values)
    folded = (
        before.select(*keys, record.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(after.select(*keys, record.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    same = folded.where("a > 0 and b > 0").select(
        *keys, F.lit("same").alias("change"), F.col("v").alias("before"), F.col("v").alias("after"), F.least("a", "b").alias("n"))

    # A key's rows that are left, one behind the other: where each begins, and where the last one ends.
    rest = folded.where("a <> b").select(
        *keys, "v", F.when(F.col("a") > F.col("b"), "a").otherwise("b").alias("side"), F.abs(F.col("a") - F.col("b")).alias("n"))
    line = Window.partitionBy(*keys, "side").orderBy("v")
    laid = rest.withColumn("upto", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    begins = laid.select(*keys, (F.col("upto") - F.col("n")).alias("at"), "side", F.struct(F.lit(True).alias("on"), "v").alias("r"))
    ends = laid.groupBy(*keys, "side").agg(F.max("upto").alias("at")).select(
        *keys, "at", "side", F.struct(F.lit(False).alias("on"), F.lit(None).cast(rest.schema["v"].dataType).alias("v")).alias("r"))
    cuts = begins.unionByName(ends).groupBy(*keys, "at").agg(
        F.max(F.when(F.col("side") == "a", F.col("r"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("r"))).alias("b"))
    order = Window.partitionBy(*keys).orderBy("at")
    runs = cuts.select(
        *keys, (F.lead("at").over(order) - F.col("at")).alias("n"),
        *[F.last(side, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(side) for side in "ab"])
    on_a, on_b = (F.coalesce(F.col(f"{side}.on"), F.lit(False)) for side in "ab")
    paired = runs.where(F.col("n").isNotNull()).select(
        *keys, F.when(on_a & on_b, "changed").when(on_a, "removed").otherwise("added").alias("change"),
        F.col("a.v").alias("before"), F.col("b.v").alias("after"), "n")
    return same.unionByName(paired).groupBy(*keys, "change", "before", "after").agg(F.sum("n").alias("n"))
