"""Tags, assignments and coordinated deletes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropledger.operators.sequence import numbered


def split_by_delete_set(table: DataFrame, delete_set: DataFrame, keys: Sequence[str],
                        store: str) -> DataFrame:
    """Apply a delete set to one store and report (store, removed, remaining).

    The delete set is made distinct first so the left join cannot multiply
    rows; the counts are a single partial-aggregated pass.
    """
    keys = list(keys)
    d = delete_set.select(*keys).distinct().withColumn("_del", F.lit(True))
    j = table.join(d, keys, "left")
    return j.agg(F.count_if(F.col("_del").isNotNull()).alias("removed"),
                 F.count_if(F.col("_del").isNull()).alias("remaining")) \
        .select(F.lit(store).alias("store"), "removed", "remaining")


def tags_for(tags: DataFrame, assignments: DataFrame, scope: str, scope_key: str) -> DataFrame:
    """Tags assigned to one (scope, key), ordered by name (the only inner join)."""
    a = assignments.filter((F.col("scope") == scope) & (F.col("scope_key") == scope_key))
    return tags.join(a.select("tag_id"), "tag_id", "inner").orderBy("name")


def keys_with_tag(assignments: DataFrame, chosen_tags: DataFrame, scope: str) -> DataFrame:
    """Scope keys carrying any of the chosen tags (order unspecified)."""
    a = assignments.filter(F.col("scope") == scope)
    return a.join(chosen_tags.select("tag_id"), "tag_id", "left_semi").select("scope_key")


def create_tags(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add tags (name, color) with fresh ids; a name that exists already, or
    repeats in the batch, is an error (unique names; nulls count as equal).

    Names meet in one aggregate, and a name that is not unique raises in the
    plan.  Ids continue after the largest existing id in name order, counted
    by range (:func:`sequence.numbered`), so the batch may have any size.
    Nothing is returned before the names have been checked.
    """
    was = existing.agg(F.max("tag_id")).first()[0] or 0
    both = new.select("name", F.struct(*new.columns).alias("_new")).unionByName(
        existing.select("name", F.lit(None).alias("_new")))
    met = both.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_new"))
    repeated = F.raise_error(F.concat(F.lit("tag name already exists: "), F.coalesce(F.col("name"), F.lit("NULL"))))
    checked = met.select(F.when(F.col("_n") > 1, repeated.cast(existing.schema["name"].dataType)).otherwise(F.col("name")).alias("name"), "_new")
    try:
        fresh = numbered(checked.where("_new is not null").select("name", *[F.col("_new")[c].alias(c) for c in new.columns if c != "name"]),
                         ["name"], "tag_id")
    except SparkRuntimeException as exc:
        if exc.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        raise ValueError(exc.getMessageParameters()["errorMessage"]) from exc
    return existing.unionByName(fresh.withColumn("tag_id", F.col("tag_id") + F.lit(was).cast("long")).select(*existing.columns))


def cascade_fold(log: DataFrame, keys: Sequence[str], doomed: Column, stores: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """Coordinated delete where all stores are folds of one change log, in one pass over it.

    ``stores`` maps a store's name to (whether a row puts its key there, the
    item it adds there or None for the key alone).  Returns (keys…, store,
    item, removed): each entry once, ``removed`` if any row of its key is
    ``doomed``.  A key with a null or empty part has no code: no store of it
    is touched.  A key's items are distinct values of a dimension (tags), so
    its row stays small.  Null conditions count as no; null items are no entries.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    aggs = [F.bool_or(yes(doomed)).alias("_doomed")]
    for i, (inside, item) in enumerate(stores.values()):
        aggs.append((F.bool_or(yes(inside)) if item is None else F.collect_set(F.when(yes(inside), item))).alias(f"_in{i}"))
    entry = lambda name: lambda item: F.struct(F.lit(name).alias("store"), item.cast("string").alias("item"))
    lists = []
    for i, (name, (_, item)) in enumerate(stores.items()):
        if item is None:
            lists.append(F.when(F.col(f"_in{i}"), F.array(entry(name)(F.lit(None)))).otherwise(F.array().cast("array<struct<store:string,item:string>>")))
        else:
            lists.append(F.transform(f"_in{i}", entry(name)))
    coded = F.lit(True)
    for k in keys:
        coded = coded & yes(F.col(k).cast("string") != "")
    folded = log.groupBy(*keys).agg(*aggs).select(*keys, (F.col("_doomed") & coded).alias("removed"), F.explode(F.concat(*lists)).alias("_e"))
    return folded.select(*keys, "_e.store", "_e.item", "removed")


def cascade_report(entries: DataFrame, stores: Sequence[str]) -> DataFrame:
    """(store, removed, remaining) of :func:`cascade_fold`'s entries, a row for each store even if it is empty."""
    one = F.col("store")
    counts = entries.agg(*[f.alias(f"{k}{i}") for i, s in enumerate(stores) for k, f in (
        ("_r", F.count_if((one == s) & F.col("removed"))), ("_k", F.count_if((one == s) & ~F.col("removed"))))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("store"), F.col(f"_r{i}").alias("removed"), F.col(f"_k{i}").alias("remaining"))
                                            for i, s in enumerate(stores)])))


def coordinated_delete(delete_set: DataFrame, catalogue: DataFrame, bridge: DataFrame, manifest: DataFrame,
                       ym: str = "publish_ym", code: str = "target_code"):
    """Delete files from catalogue, tag bridge and manifest together.

    Each store is handled independently (an anti join); a file without a
    code touches none of them (only the file itself goes).  Returns the three
    new tables and a (store, removed, remaining) report.
    """
    d = delete_set.filter(F.col(code).isNotNull() & (F.col(code) != "")).select(ym, code).distinct()
    keys = [ym, code]
    sk = d.select(F.concat(F.col(ym), F.lit("/"), F.col(code)).alias("scope_key"))
    new_cat = catalogue.join(d, keys, "left_anti")
    new_bridge = bridge.join(sk, "scope_key", "left_anti")
    new_manifest = manifest.join(d, keys, "left_anti")
    report = (split_by_delete_set(catalogue, d, keys, "catalogue")
              .unionByName(split_by_delete_set(bridge, sk, ["scope_key"], "tag_bridge"))
              .unionByName(split_by_delete_set(manifest, d, keys, "manifest")))
    return new_cat, new_bridge, new_manifest, report
