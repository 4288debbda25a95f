"""Mutable catalogue tables as append-only change logs and their folds.

Every mutable table is a log ``(key..., payload..., seq[, op])``; its current
state is a fold.  Folds are plain aggregates (``max_by``/``min_by``), so
Spark runs them with a map-side partial aggregate: a key holding a third of
all rows is reduced to one row per input partition before the shuffle.
No window functions are used for "last wins" rules for exactly that reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seq_col(seq: str | Sequence[str]) -> Column:
    if isinstance(seq, str):
        return F.col(seq)
    return F.struct(*[F.col(s) for s in seq])


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def after_last_tombstone(log: DataFrame, keys: Sequence[str], seq: str | Sequence[str],
                         op: str, delete_value: str = "d") -> DataFrame:
    """Rows of each key that follow its last tombstone (the key's current life).

    A key whose last op is a delete has no rows left.  The tombstone table is
    one row per deleted key and is joined back on the key; AQE splits a hot
    key's partition on the log side if one key dominates.
    """
    keys = _names(keys)
    s = _seq_col(seq)
    tomb = (log.filter(F.col(op) == delete_value)
            .groupBy(*keys).agg(F.max(s).alias("_last_tomb")))
    return (log.join(tomb, keys, "left")
            .filter(F.col("_last_tomb").isNull() | (s > F.col("_last_tomb")))
            .drop("_last_tomb"))


def fold_state(log: DataFrame, keys: Sequence[str], seq: str | Sequence[str],
               last: Sequence[str] = (), first: Sequence[str] = (),
               op: str | None = None, delete_value: str = "d",
               versions: str | None = None, also: Mapping[str, Column] | None = None) -> DataFrame:
    """Current state of a change log.

    ``last`` columns take the value of the latest row per key (upsert
    replaces), ``first`` columns keep the value of the earliest row of the
    key's current life (e.g. ``detected_at`` survives later upserts).  With
    ``op`` set, rows up to the key's last ``delete_value`` are discarded.
    With ``op`` and only ``last`` columns the fold is one partial aggregate
    (the latest row, unless it is a tombstone); ``first`` columns or a
    version count need the key's last tombstone joined back first, so the log
    is read twice: write it first if it isn't a plain scan.  ``also`` names
    further aggregates of the same pass (without ``op`` only).
    """
    keys = _names(keys)
    s = _seq_col(seq)
    if op is not None and last and not first and not versions:
        # Only the latest row matters: it is the current state unless it is a
        # tombstone.  One partial aggregate, no join back to the log.
        r = log.groupBy(*keys).agg(F.max_by(F.struct(F.col(op).alias("_op"), *[F.col(c) for c in last]), s).alias("_r"))
        return (r.filter(~(F.col("_r._op") == F.lit(delete_value)) | F.col("_r._op").isNull())
                .select(*[F.col(k) for k in keys], *[F.col("_r")[c].alias(c) for c in last]))
    if op is not None:
        if also:
            raise ValueError("further aggregates need a fold without deletes")
        log = after_last_tombstone(log, keys, seq, op, delete_value)
    aggs = []
    if last:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in last]), s).alias("_last"))
    if first:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in first]), s).alias("_first"))
    if versions:
        aggs.append(F.count(F.lit(1)).alias(versions))
    aggs += [c.alias(name) for name, c in (also or {}).items()]
    if not aggs:
        aggs.append(F.count(F.lit(1)).alias("_n"))
    out = log.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys]
    cols += [F.col("_last")[c].alias(c) for c in last]
    cols += [F.col("_first")[c].alias(c) for c in first]
    if versions:
        cols.append(F.col(versions))
    return out.select(*cols, *[F.col(name) for name in (also or {})])


def retract(log: DataFrame, keys: Sequence[str], withdrawn: Column) -> DataFrame:
    """Insert-or-ignore, then withdrawal, in one pass: keys of which no row is ``withdrawn`` (NULL counts as no)."""
    return (log.groupBy(*keys).agg(F.bool_or(F.coalesce(withdrawn, F.lit(False))).alias("_out"))
            .where(~F.col("_out")).select(*keys))


def insert_or_ignore(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore semantics: one row per key (a distinct aggregate)."""
    return log.select(*keys).dropDuplicates(list(keys))


def remove_matching(table: DataFrame, removals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete every row whose key appears in ``removals`` (anti join)."""
    return table.join(removals.select(*keys), list(keys), "left_anti")


def toggle_parity(log: DataFrame, keys: Sequence[str], count_col: str = "toggles") -> DataFrame:
    """Present → remove, absent → add: a key is present after an odd number of toggles."""
    return (log.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
            .filter(F.col(count_col) % 2 == 1))


def duplicate_keys(table: DataFrame, keys: Sequence[str], count_col: str = "n") -> DataFrame:
    """Keys violating a uniqueness constraint (with their multiplicity)."""
    return (table.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
            .filter(F.col(count_col) > 1))


def orphans(child: DataFrame, parent: DataFrame, child_keys: Sequence[str],
            parent_keys: Sequence[str] | None = None) -> DataFrame:
    """Referential-integrity violations: child rows without a parent row."""
    parent_keys = list(parent_keys or child_keys)
    p = parent.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_keys, child_keys)])
    return child.join(p, list(child_keys), "left_anti")


def purge_before(log: DataFrame, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Retention purge: (kept rows, purged rows) split at ``cutoff``.

    Like ``DELETE ... WHERE ts < cutoff``: a NULL stamp is never purged.
    """
    purged = purge_predicate(ts, cutoff)
    return log.filter(~purged), log.filter(purged)


def purge_predicate(ts: str, cutoff) -> Column:
    """True for rows a ``DELETE ... WHERE ts < cutoff`` removes (never NULL)."""
    c = F.lit(cutoff) if not isinstance(cutoff, Column) else cutoff
    return F.coalesce(F.col(ts) < c, F.lit(False))
