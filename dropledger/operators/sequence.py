"""Per-key event sequences (previous event, sessions) that survive hot keys.

A plain ``lag(...) OVER (PARTITION BY key ORDER BY ts)`` sends all events of
a key to one task.  Here events are dealt by range of (key, time), so a key,
or a single hour of it, is cut wherever a task is full, and they are shuffled
once.  Each task goes through its sorted events and knows all but what went
before its first one: it also gives one row about its first and last event.
These rows, one a task, say what each range carries on from the one before:
the last time of its first key, and how many sessions of it have begun.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from dropledger.session import prepare, written


def _new_key(keys: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each key differs from the one before it (null is a key like any other)."""
    first = pa.nulls(1, keys.type) if before is None else pa.array([before.as_py()], keys.type)
    shifted = pa.concat_arrays([first, keys.slice(0, len(keys) - 1)])
    same = pc.or_(pc.fill_null(pc.equal(keys, shifted), False), pc.and_(pc.is_null(keys), pc.is_null(shifted)))
    out = ~same.to_numpy(zero_copy_only=False)
    if before is None:
        out[0] = True
    return out


def _ranged(key: str, ts: str, gap_us: int | None, names: list[str]):
    """Maps sorted events to (…, previous time, session in this range), and a last row about the range's ends."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None  # (key, time) of the range's ends
        session, single, schema = 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times, schema = batch.column(key), batch.column(ts), batch.schema
            new = _new_key(keys, None if last is None else last[0])
            opens = first is None
            if opens:
                first = (keys[0], times[0])
            shifted = pa.concat_arrays([
                pa.nulls(1, times.type) if last is None else pa.array([last[1].as_py()], times.type), times.slice(0, len(times) - 1)])
            prev = pc.if_else(pa.array(new), pa.nulls(len(new), times.type), shifted)
            if gap_us is None:
                starts = new
            else:
                gone = pc.subtract(times.cast(pa.int64()), prev.cast(pa.int64()))
                starts = pc.or_(pc.is_null(prev), pc.fill_null(pc.greater(gone, gap_us), False)).to_numpy(zero_copy_only=False)
            # Sessions count from 1 at each key's first event in this range.
            run = np.cumsum(starts) + session
            before_key = np.where(new, run - 1, 0)
            local = run - np.maximum.accumulate(before_key)
            other = np.maximum.accumulate(new & ~(np.arange(len(new)) == 0) if opens else new) | (not single)
            single = not other[-1]
            last, session = (keys[-1], times[-1]), int(local[-1])
            firsts = np.zeros(len(new), bool)
            firsts[0] = opens
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(new), part, np.int32)), pa.array(firsts), pa.array(~other), prev, pa.array(local),
                 *[pa.nulls(len(new), keys.type)] * 2, *[pa.nulls(len(new), times.type)] * 2, pa.nulls(len(new), pa.bool_())],
                names=names)
        if last is not None:
            kt, tt = schema.field(key).type, schema.field(ts).type
            ends = [pa.array([x.as_py()], t) for x, t in ((first[0], kt), (last[0], kt), (first[1], tt), (last[1], tt))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, f.type) for f in schema), pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.bool_()),
                 pa.nulls(1, tt), pa.array([session]), *ends, pa.array([single])], names=names)

    return rows


def _sequenced(df: DataFrame, key: str, order: Sequence[str], gap_seconds: int | None) -> DataFrame:
    """``df`` with ``_seq``: struct (prev, session)."""
    prepare(df.sparkSession)
    ts, gap_us = order[0], None if gap_seconds is None else gap_seconds * 1_000_000
    kt, tt = df.schema[key].dataType, df.schema[ts].dataType
    extra = [("_part", IntegerType()), ("_first", BooleanType()), ("_head", BooleanType()), ("_prev", tt), ("_session", LongType()),
             ("_first_key", kt), ("_last_key", kt), ("_first_ts", tt), ("_last_ts", tt), ("_single", BooleanType())]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + [StructField(n, x) for n, x in extra])
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    table = written(ranged.mapInArrow(_ranged(key, ts, gap_us, [f.name for f in schema.fields]), schema), "sequence")

    by_part = Window.orderBy("_part")  # a row for each range
    ends = table.where("_single is not null").select(
        "_part", "_first_ts", "_last_ts", "_single", "_session", F.lag("_last_ts").over(by_part).alias("_carry"),
        F.coalesce(F.lag("_last_key").over(by_part).eqNullSafe(F.col("_first_key")) & F.lag("_session").over(by_part).isNotNull(),
                   F.lit(False)).alias("_same"))
    joins = F.lit(0)
    if gap_us is not None:
        quiet = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("_carry"), F.col("_first_ts")) <= gap_us, F.lit(False))
        joins = F.when(F.col("_same") & quiet, 1).otherwise(0)  # the range's first session began in the one before
    ends = ends.withColumn("_joins", joins).withColumn("_goes_on", F.col("_single") & F.col("_same"))
    # Ranges that hold one key only hand on what they were handed; the others begin anew with their last key.
    ends = ends.withColumn("_chain", F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(by_part))
    total = F.sum(F.col("_session") - F.when(F.col("_goes_on"), F.col("_joins")).otherwise(0)).over(
        Window.partitionBy("_chain").orderBy("_part"))
    ends = ends.withColumn("_total", total)
    carried = ends.select(
        "_part", F.when(F.col("_same"), F.col("_carry")).alias("_carry"),
        F.when(F.col("_same"), F.lag("_total").over(by_part) - F.col("_joins")).otherwise(0).alias("_base"))
    rows = table.where("_single is null").join(F.broadcast(carried), "_part")
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")).alias("prev"),
                 (F.col("_session") + F.when(F.col("_head"), F.col("_base")).otherwise(0)).cast("long").alias("session")).alias("_seq"))


def with_previous(df: DataFrame, key: str, order: Sequence[str], prev: str = "prev_ts") -> DataFrame:
    """Add the previous event's ``order[0]`` value within the key (NULL for the first).

    Names that begin with an underscore and are used above (``_part``,
    ``_prev`` …) are reserved; a null key is a key of its own, null times come
    first; an empty table gives no rows.
    """
    return _sequenced(df, key, order, None).withColumn(prev, F.col("_seq.prev")).drop("_seq")


def with_session_id(df: DataFrame, key: str, order: Sequence[str], gap_seconds: int, session: str = "session_id") -> DataFrame:
    """Number each key's sessions from 1: a new session starts when the gap to
    the previous event exceeds ``gap_seconds`` (an event exactly at the gap joins)."""
    return _sequenced(df, key, order, gap_seconds).withColumn(session, F.col("_seq.session")).drop("_seq")


def numbered(df: DataFrame, order: Sequence[str], number: str = "n") -> DataFrame:
    """Number all rows from 1 in ``order`` (ties in any order) without a window over them: rows are dealt by
    range and written once; the ranges' counts, a row for each, say where a range begins."""
    mid = "_mid"
    table = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(mid, 33), F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))  # how Spark forms these ids
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    j = table.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return j.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + place + 1).cast("long").alias(number))
