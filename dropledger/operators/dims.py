"""Dimension helpers: the region master, overrides, selections, code checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_dimension(df: DataFrame, dim: DataFrame, alias: str = "_dim",
                      max_rows: int | None = None) -> DataFrame:
    """Pair every row of ``df`` with every row of a dimension.

    The dimension becomes one array through a scalar subquery (evaluated
    once, inside the plan) and each row explodes it: a local generator, no
    join, no driver trip.  A caller that knows a bound may have the query
    fail beyond it (``max_rows``).
    """
    arr = dim.select(F.collect_list(F.struct(*[F.col(c) for c in dim.columns]))).scalar()
    guarded = arr if max_rows is None else F.when(F.size(arr) > max_rows,
                     F.raise_error(F.lit(f"dimension exceeds its bound of {max_rows} rows"))).otherwise(arr)
    return df.withColumn(alias, F.explode(guarded)).select(*df.columns, f"{alias}.*")


def apply_overrides(master: DataFrame, overrides: DataFrame, code: str = "code",
                    value: str = "filename_key", pos: str = "pos") -> DataFrame:
    """Replace ``value`` where an override for the code exists; last override wins.

    Overrides lacking either field are ignored; codes unknown to the master
    are ignored by the left join.  The override list is reduced to one row
    per code with a partial aggregate before it is joined.
    """
    o = (overrides.filter(F.col(code).isNotNull() & F.col(value).isNotNull())
         .groupBy(code).agg(F.max_by(F.col(value), F.col(pos)).alias("_override")))
    j = master.join(o, code, "left")
    return j.select(*[F.coalesce(F.col("_override"), F.col(value)).alias(value) if c == value else F.col(c)
                      for c in master.columns],
                    F.col("_override").isNotNull().alias("overridden"))


def checked_master(master: DataFrame, code: str = "code", order: str = "target_order") -> DataFrame:
    """The region master, raising in the plan unless codes are unique and the orders are 1 to n, each once.

    Two aggregates over the bounded master and a scalar subquery for n, read
    with the rows: no job of its own.  Nulls break both rules.
    """
    m = master.select(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(code)).alias("codes"), F.count_distinct(F.col(order)).alias("orders"),
                      F.min(order).alias("lo"), F.max(order).alias("hi"))
    fault = (F.when(F.col("codes") != F.col("n"), F.lit("region master: a code is missing or repeated"))
             .when((F.col("orders") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")),
                   F.lit("region master: orders are not 1 to n")))
    found = m.select(fault.alias("fault")).scalar()
    kept = F.when(found.isNotNull(), F.raise_error(found).cast(master.schema[code].dataType)).otherwise(F.col(code))
    return master.select(*[kept.alias(c) if c == code else F.col(c) for c in master.columns])


def by_codes(master: DataFrame, wanted: DataFrame, code: str = "code") -> DataFrame:
    """The master's row for each wanted row, with the wanted rows' other columns; an unknown or null code raises in the plan."""
    known = master.withColumn("_known", F.lit(True))
    j = wanted.join(known, code, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown target code: "), F.coalesce(F.col(code), F.lit("NULL"))))
    checked = F.when(F.col("_known").isNull(), unknown.cast(master.schema[code].dataType)).otherwise(F.col(code))
    return j.select(checked.alias(code), *[c for c in j.columns if c not in (code, "_known")])


def select_targets(master: DataFrame, selection: DataFrame | None, code: str = "code") -> DataFrame:
    """Empty selection = the whole master; otherwise membership (unknown codes vanish)."""
    if selection is None:
        return master
    chosen = selection.select(code).distinct().withColumn("_chosen", F.lit(True))
    nothing_chosen = selection.agg(F.count(F.lit(1))).scalar() == 0
    return master.join(chosen, code, "left").filter(F.col("_chosen") | nothing_chosen).select(*master.columns)


def code_validity(codes: DataFrame, master: DataFrame, code: str = "code") -> DataFrame:
    """Each distinct code with a validity flag (intersection vs. difference)."""
    m = master.select(code).distinct().withColumn("is_valid", F.lit(True))
    return (codes.select(code).distinct().join(m, code, "left")
            .select(code, F.coalesce("is_valid", F.lit(False)).alias("is_valid")))


def selection_summary(selected_count: Column, total_count: Column) -> Column:
    """``n / total`` label, or the "all" form when every target is selected."""
    # Fixed label texts: "全 {total} 地域" and "{selected} / {total} 地域".
    return F.when(selected_count == total_count,
                  F.concat(F.lit("全 "), total_count.cast("string"), F.lit(" 地域"))
                  ).otherwise(F.concat(selected_count.cast("string"), F.lit(" / "),
                                       total_count.cast("string"), F.lit(" 地域")))

