"""Reconciliation between landed files, manifest entries and the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropledger.operators.outcomes import content_hash


def hash_reconcile(targets: DataFrame, recorded: DataFrame, landed: DataFrame,
                   key: str = "target", content: str = "text") -> DataFrame:
    """Decide per target: skip, or fetch as new / changed / missing.

    A target is skipped only if its file has landed, a manifest entry with a
    non-empty hash exists, and the landed content has its size and hash.
    ``recorded``: (key, sha256, size); ``landed``: (key, size, content).
    """
    r = recorded.select(F.col(key), F.col("sha256").alias("_rec_hash"), F.col("size").alias("_rec_size"),
                        F.lit(True).alias("_has_rec"))
    # Hashed where it is read: 64 characters travel, not the content.
    f = landed.select(F.col(key), F.col("size").alias("_size"), content_hash(content).alias("_hash"),
                      F.lit(True).alias("_has_file"))
    j = targets.select(key).join(r, key, "left").join(f, key, "left")
    action = (F.when(F.col("_has_file").isNull(), F.lit("missing"))
              .when(F.col("_has_rec").isNull() | (F.coalesce(F.col("_rec_hash"), F.lit("")) == ""), F.lit("new"))
              .when((F.col("_rec_size") == F.col("_size"))
                    & (F.col("_rec_hash") == F.col("_hash")), F.lit("skip"))
              .otherwise(F.lit("changed")))
    return j.select(F.col(key), action.alias("action"))


def memo_lookup(listing: DataFrame, cache: DataFrame, keys: Sequence[str] = ("path", "length", "mtime"),
                size_col: str = "length") -> DataFrame:
    """Memoised statistics: a cache hit only when every key column matches.

    Hit → (uncompressed size if non-zero else on-disk size, cached row count);
    miss → (on-disk size, NULL row count).  ``cache``: keys + row_count,
    uncompressed_size.
    """
    keys = list(keys)
    # One row for each key (of repeated ones the greatest), so that no listed file is multiplied.
    c = (cache.groupBy(*keys).agg(F.max(F.struct("row_count", "uncompressed_size")).alias("_row"))
         .select(*keys, F.col("_row.row_count").alias("_rc"), F.col("_row.uncompressed_size").alias("_us"),
                 F.lit(True).alias("_hit")))
    j = listing.join(c, keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        *listing.columns,
        F.when(hit, F.coalesce(F.nullif(F.col("_us"), F.lit(0)), F.col(size_col))).otherwise(F.col(size_col)).alias("display_size"),
        F.when(hit, F.col("_rc")).alias("row_count"),
        hit.alias("cache_hit"),
    )


def evict_stale(cache: DataFrame, listing: DataFrame, valid: DataFrame,
                path: str = "path", well_formed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(surviving cache rows, evicted rows).

    A row survives only if its key is well formed, its path is in the valid
    set and the file still exists in the listing.  Both sets are made
    distinct and joined as flags, so cache rows are never multiplied.
    """
    v = valid.select(path).distinct().withColumn("_valid", F.lit(True))
    e = listing.select(path).distinct().withColumn("_exists", F.lit(True))
    ok = well_formed if well_formed is not None else F.lit(True)
    j = cache.join(v, path, "left").join(e, path, "left")
    alive = F.coalesce(ok, F.lit(False)) & F.col("_valid").isNotNull() & F.col("_exists").isNotNull()
    j = j.withColumn("_alive", alive)
    cols = cache.columns
    return j.filter("_alive").select(*cols), j.filter(~F.col("_alive")).select(*cols)


def upsert_stats(cache: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("path", "length", "mtime")) -> DataFrame:
    """Stats-cache upsert: fresh rows replace cached rows of the same key."""
    keys = list(keys)
    old = cache.join(fresh.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*cache.columns))


def update_by_presence(rows: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` of rows that have an update (even with NULL values)."""
    one = updates.groupBy(key).agg(F.max(F.struct(*cols)).alias("_row"))  # of repeated keys the greatest row
    u = one.select(F.col(key), *[F.col(f"_row.{c}").alias(f"_u_{c}") for c in cols], F.lit(True).alias("_upd"))
    j = rows.join(u, key, "left")
    return j.select(*[F.when(F.col("_upd"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                      else F.col(c) for c in rows.columns])


def precedence_merge(disk: DataFrame, manifest: DataFrame, catalogue: DataFrame,
                     key: str, fields: Sequence[str], fallback_name: Column) -> DataFrame:
    """Three-way left join where a whole row source wins, not single columns.

    If a manifest row exists every field comes from it; else from the
    catalogue row; else the display name falls back and the rest are NULL.
    ``status`` (if present in the catalogue) always comes from the catalogue.
    """
    fields = list(fields)
    m = manifest.select(F.col(key), F.struct(*fields).alias("_m"))
    c_cols = [f for f in fields]
    cat_extra = [c for c in catalogue.columns if c == "status"]
    c = catalogue.select(F.col(key), F.struct(*c_cols).alias("_c"), *cat_extra)
    j = disk.join(m, key, "left").join(c, key, "left")
    fb = F.struct(*[(fallback_name if f == "display_name" else F.lit(None).cast(manifest.schema[f].dataType)).alias(f)
                    for f in fields])
    chosen = F.when(F.col("_m").isNotNull(), F.col("_m")).when(F.col("_c").isNotNull(), F.col("_c")).otherwise(fb)
    src = (F.when(F.col("_m").isNotNull(), F.lit("manifest")).when(F.col("_c").isNotNull(), F.lit("catalogue"))
           .otherwise(F.lit("disk")))
    out = [F.col(x) for x in disk.columns] + [chosen[f].alias(f) for f in fields] + [src.alias("source_kind")]
    if cat_extra:
        out.append(F.col("status"))
    return j.select(*out)
