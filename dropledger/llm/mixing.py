"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks; time is counted in slots of one
block.  Each source is served by its weight over the weights of the sources
that aren't through yet, so shares change only when a source ends.  In this
ideal flow, source p with integer weight w has received j blocks when each
source s with n blocks has received min(n, s.w j / w): at the time that these
add up to.  Block j is released at the floor of its begin and due at the
ceiling of its end; earliest deadline first among the released blocks (of
equal ones the earlier release, then source) fills the slots.  For unit blocks
and a flow of one block a slot this meets every deadline, so at any slot a
source has received its target up to less than one block, however many slots
and sources there are.

The slots are cut into stretches, at most ``STRETCHES`` of them, that are
scheduled side by side.  A chain of small steps, one a stretch, says how many
blocks each source has at every cut: those that are due, and of those under
way at the cut (one a source at most) as many as slots are left, the earliest
deadline first, if the slots since their release hold them too (the free slots
of a stretch are counted side by side before).  By Hall's condition a schedule
within all windows goes through these counts, so earliest deadline first finds
one in each stretch by itself, with windows cut at its ends.  The chain grows
with stretches times the square of the sources and not with the rows; a
stretch is one task.

Nothing is dropped: a source that runs out leaves its slots to the others.
Windows are exact in integers.

The order within a source is by a hash of the whole row.  Hash buckets are
counted and cut into blocks without moving a text; a row then goes once to its
bucket, where its number, block and position follow, and for the laid out
table once more to its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, read_table

ROWS_PER_BUCKET = 10_000
#: Slots that one task schedules, and the most stretches; beyond their product stretches get longer.
SLOTS_PER_STRETCH = 1 << 14
STRETCHES = 4096
#: Slots whose blocks are listed at once.
SLOTS_PER_LIST = 256
#: Release of the block after a source's last one in a stretch.
NEVER = 1 << 62

_PICK = "struct<due:bigint,free:bigint,i:int,j:bigint,at:bigint>"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _edge(i: str, j: str, up: str) -> str:
    """SQL: when source ``i`` of ``s`` has received ``j`` blocks in the ideal flow, rounded up by ``up``."""
    w = f"s[{i}].w"
    return f"""
      aggregate(s, named_struct('done', 0L, 'active', 0L),
        (e_, x_) -> if(x_.n * {w} <= x_.w * ({j}), named_struct('done', e_.done + x_.n, 'active', e_.active),
                       named_struct('done', e_.done, 'active', e_.active + x_.w)),
        e_ -> e_.done + (e_.active * ({j}) + {up}) div {w})"""


def _begin(i: str, j: str) -> str:
    return _edge(i, j, "0L")


def _end(i: str, j: str) -> str:
    return _edge(i, f"{j} + 1", f"s[{i}].w - 1")


def _flow(t: str) -> str:
    """SQL: for each source its whole blocks at time ``t`` in the ideal flow, and whether a part of one comes on top."""
    over = f"""aggregate(s, named_struct('done', 0L, 'active', 0L),
      (e, x) -> if(x.fin <= {t}, named_struct('done', e.done + x.n, 'active', e.active),
                   named_struct('done', e.done, 'active', e.active + x.w)))"""
    return _let("o", over, f"""transform(s, x -> if(x.fin <= {t}, named_struct('full', x.n, 'part', false),
      named_struct('full', (x.w * ({t} - o.done)) div o.active, 'part', (x.w * ({t} - o.done)) % o.active > 0)))""")


#: Of the stretch from ``t0`` to ``t1``: whole blocks of each source at its end, the blocks under way there, and, for
#: each release r of these after ``t0``, the fewest slots that the blocks due by ``t1`` leave free from any slot on
#: that lies behind the release before, up to r.
_STRETCH = _let("f", _flow("t1"), _let("c", f"""array_sort(filter(transform(f, (y, i) -> if(y.part,
    named_struct('due', {_end("i", "y.full")}, 'i', i, 'free', {_begin("i", "y.full")}), null)), z -> z is not null))""", _let(
    "d", "array_sort(array_distinct(filter(transform(c, z -> z.free), r -> r > t0)))",
    f"""named_struct('full', transform(f, y -> y.full), 'under_way', c, 'room', transform(d, (r, b) -> named_struct('at', r, 'room',
      array_min(transform(sequence(if(b = 0, t0, d[b - 1]) + 1, r), q -> (t1 - q) - {_let(
        "g", _flow("q"), "aggregate(zip_with(f, g, (y, z) -> greatest(0L, y.full - z.full - if(z.part, 1L, 0L))), 0L, (e, v) -> e + v)")})))))""")))

#: The blocks of each source at all cuts, from the array ``stretches`` in order.
_CUTS = f"""
aggregate(stretches,
  named_struct('a', transform(s, x -> 0L), 'cuts', array(transform(s, x -> 0L))),
  (acc, h) -> {_let("k", "zip_with(acc.a, h.full, (x, y) -> greatest(x, y))", _let(
      "p", """aggregate(filter(h.under_way, z -> acc.a[z.i] <= h.full[z.i]),
        named_struct('left', h.t1 - aggregate(k, 0L, (e, v) -> e + v), 'room', h.room, 'picked', cast(array() as array<int>)),
        (g, z) -> if(g.left > 0 and forall(g.room, x -> x.at > z.free or x.room > 0),
          named_struct('left', g.left - 1, 'room', transform(g.room, x -> if(x.at <= z.free, named_struct('at', x.at, 'room', x.room - 1), x)),
                       'picked', concat(g.picked, array(z.i))), g), g -> g.picked)""",
      _let("n", "transform(k, (x, i) -> x + if(array_contains(p, i), 1L, 0L))",
           "named_struct('a', n, 'cuts', concat(acc.cuts, array(n)))")))},
  acc -> acc.cuts)
"""


def _window(i: str, j: str) -> str:
    """SQL: block ``j`` of source ``i`` as (due, free, i, j, at) in the stretch up to ``upto``, where sources have ``last``."""
    return f"""
      if({j} < last[{i}],
         named_struct('due', least(upto, {_end(i, j)}), 'free', {_begin(i, j)}, 'i', {i}, 'j', {j}, 'at', 0L),
         named_struct('due', {NEVER}L, 'free', {NEVER}L, 'i', {i}, 'j', {j}, 'at', 0L))"""


#: Earliest deadline first from slot ``low0`` to ``upto``: ``next`` holds the next block of each source, ``at`` a block's first row.
_EDF = f"""
aggregate(
  sequence(low0, greatest(low0, upto - 1), {SLOTS_PER_LIST}L),
  named_struct('next', transform(first, (x, i) -> {_window("i", "x")}),
               'rows', low0 * block_rows - aggregate(zip_with(s, first, (x, y) -> if(x.n = y, x.lack, 0L)), 0L, (e, x) -> e + x),
               'lists', cast(array() as array<array<{_PICK}>>)),
  (acc, low) -> aggregate(
    array(aggregate(
      sequence(low, least(low + {SLOTS_PER_LIST}L, upto) - 1),
      named_struct('next', acc.next, 'rows', acc.rows, 'picks', cast(array() as array<{_PICK}>)),
      (a, t) -> aggregate(
        array(array_min(filter(a.next, z -> z.free <= t))),
        a,
        (b, p) -> named_struct(
          'next', transform(b.next, z -> if(z.i = p.i, {_window("z.i", "z.j + 1")}, z)),
          'rows', b.rows + block_rows - if(p.j + 1 = s[p.i].n, s[p.i].lack, 0L),
          'picks', concat(b.picks, array(named_struct('due', {_end("p.i", "p.j")}, 'free', p.free, 'i', p.i, 'j', p.j, 'at', b.rows))))))),
    acc,
    (a, x) -> named_struct('next', x.next, 'rows', x.rows, 'lists', concat(a.lists, array(x.picks)))),
  acc -> acc.lists)
"""


def _source_counts(docs: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """A row for each source: (source_key, n_rows, weight)."""
    counts = docs.groupBy(F.coalesce(source_col, F.lit("")).alias("source_key")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    if weights:
        table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
        weight = F.coalesce(table[F.col("source_key")].cast("double"), F.lit(0.0))
    else:
        weight = F.pow("n_rows", F.lit(float(temperature)))
    return counts.withColumn("weight", weight)


def source_weights(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None,
                   temperature: float = 0.5, block_rows: int = 4) -> DataFrame:
    """A row for each source: (source_key, idx, n_rows, n_blocks, weight, w).

    ``weight`` is the target share and ``w`` the same as an integer, as fine as
    products with block counts in 64 bits allow.  Weights are the given ones (a
    source without one gets 0 and is served when the others are through), or
    the source's row count to the power ``temperature``.  A null source is the
    source ''.
    """
    every = Window.partitionBy(F.lit(0))
    total = F.sum("weight").over(every)
    return (
        _source_counts(docs, source_col, weights, temperature)
        .withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows).cast("long"))
        .withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(1 / F.count(F.lit(1)).over(every)))
        .withColumn("unit", F.least(F.lit(1 << 52), F.expr(f"{1 << 61}L div sum(n_blocks) over (partition by 0)")))
        .select("source_key", (F.row_number().over(every.orderBy("source_key")) - 1).alias("idx"), "n_rows", "n_blocks",
                F.col("share").alias("weight"),
                F.greatest(F.lit(1), F.round(F.col("share") * F.col("unit"))).cast("long").alias("w"))
    )


def block_schedule(sources: DataFrame, block_rows: int, slots_per_stretch: int = SLOTS_PER_STRETCH,
                   stretches: int = STRETCHES) -> DataFrame:
    """The slot of every block of ``source_weights``: (idx, block, release, deadline, slot, first_row).

    ``first_row`` is the place of the block's first row among all rows.
    """
    total = sources.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    per = max(slots_per_stretch, -(-total // stretches))
    plan = materialise(sources.agg(
        F.sort_array(F.collect_list(F.struct(
            "idx", F.col("n_blocks").alias("n"), "w", (F.col("n_blocks") * block_rows - F.col("n_rows")).alias("lack")))).alias("s"),
        F.coalesce(F.sum("n_blocks"), F.lit(0)).cast("long").alias("total")), "mix-sources")
    fin = _edge("x.idx", "x.n", "s[x.idx].w - 1")  # when the source has received all of its blocks
    plan = materialise(plan.withColumn("s", F.expr(
        f"transform(s, x -> named_struct('idx', x.idx, 'n', x.n, 'w', x.w, 'lack', x.lack, 'fin', {fin}))")), "mix-sources")
    parts = max(1, min(-(-total // per), 10_000))
    ends = plan.where("total > 0").select("s", "total", F.explode(F.expr(f"sequence(0L, total - 1, {per}L)")).alias("t0")).select(
        "s", "t0", F.expr(f"least(t0 + {per}L, total)").alias("t1")).repartition(parts, "t0")
    stretches = materialise(ends.select("s", "t0", "t1", F.expr(_STRETCH).alias("h")), "mix-stretches")
    chain = materialise(
        stretches.agg(
            F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("t1", "t0", "h.full", "h.under_way", "h.room"))).alias("stretches"))
        .where("size(stretches) > 0").select("s", "stretches", F.expr(_CUTS).alias("cuts")), "mix-cuts")
    cuts = chain.select("s", "cuts", F.posexplode("stretches").alias("i", "h")).select(
        "s", F.col("h.t0").alias("low0"), F.col("h.t1").alias("upto"), F.expr("cuts[i]").alias("first"), F.expr("cuts[i + 1]").alias("last"))
    lists = cuts.repartition(parts, "low0").withColumn("block_rows", F.lit(block_rows).cast("long")).select(
        "low0", F.posexplode(F.expr(_EDF)).alias("list", "picks"))
    return materialise(lists.select("low0", "list", F.posexplode("picks").alias("place", "p")).select(
        F.col("p.i").alias("idx"), F.col("p.j").alias("block"), F.col("p.free").alias("release"), F.col("p.due").alias("deadline"),
        (F.col("low0") + F.col("list") * F.lit(SLOTS_PER_LIST) + F.col("place")).cast("long").alias("slot"),
        F.col("p.at").alias("first_row")), "mix-schedule")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5,
                block_rows: int = 4, source_col: str = "source") -> DataFrame:
    """``docs`` with ``_mix``: struct (block, weight, release, deadline, slot, position).

    ``position`` numbers all rows from 0 in the mixed order.  Within a source
    the order is by a hash of the row, so a null or repeated id needs no care;
    a null source is the source ''.  All rows and columns stay, whatever their
    names (but for a column ``_mix``, which is replaced); an empty table gives
    no rows.  Rows alike in all columns go to one task.  ``docs`` is read
    three times; pass a table, not a long computation.
    """
    own = [c for c in docs.columns if c != "_mix"]
    hashed = [F.col(f"`{c}`") for c in own if not isinstance(docs.schema[c].dataType, MapType | VariantType)]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("key"), F.xxhash64(*hashed).alias("h"))
    table = materialise(source_weights(docs, source_col, weights, temperature, block_rows), "mix-weights")
    n_rows, n_sources = table.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = 1 + n_rows // ROWS_PER_BUCKET
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    named = table.select(F.col("source_key").alias("key"), "idx", "weight")
    starts = starts.join(F.broadcast(named) if n_sources <= 10_000 else named, "key")
    first, last = F.expr(f"start div {block_rows}"), F.expr(f"(start + n - 1) div {block_rows}")
    # A row for each block of a bucket; a bucket's blocks are some thousand.
    blocks = starts.select("key", "bucket", "start", "idx", "weight", F.explode(F.sequence(first, last)).alias("block"))
    places = materialise(
        blocks.join(block_schedule(table, block_rows), ["idx", "block"]).groupBy("key", "bucket", "start", "weight").agg(
            F.sort_array(F.collect_list(F.struct("block", "release", "deadline", "slot", "first_row"))).alias("blocks")), "mix-places")
    rank = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h"))
    at = F.expr(f"blocks[cast((start + r - 1) div {block_rows} - start div {block_rows} as int)]")
    placed = keyed.withColumn("r", rank).join(places, ["key", "bucket"]).withColumn("at", at)
    return placed.select(
        *[F.col("own").getField(c).alias(c) for c in own],
        F.struct(F.col("at.block").alias("block"), "weight", F.col("at.release").alias("release"), F.col("at.deadline").alias("deadline"),
                 F.col("at.slot").alias("slot"), F.expr(f"at.first_row + (start + r - 1) % {block_rows}").alias("position")).alias("_mix"))


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the mixed order: each partition holds the next run of positions, sorted.

    There are as many partitions as ``spark.sql.shuffle.partitions`` says.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = -(-max(1, docs.count()) // parts)
    mixed = mix_sources(docs, **how)
    return (
        mixed.repartitionById(parts, F.expr(f"cast(_mix.position div {rows} as int)"))
        .sortWithinPartitions("_mix.position").select([F.col(f"`{c}`") for c in mixed.columns if c != "_mix"])
    )


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed order of all documents; target weight of a source: the root of its row count."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "_mix.*")
