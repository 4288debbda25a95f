"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group that no shard boundary cuts.  Groups enter,
largest first, the shard with the tightest remaining capacity that still holds
them; a balanced tree keyed by remaining capacity finds it.

At scale the packing doesn't see groups one by one.  A group's weight (bytes
of all its rows) is rounded up to 12 significant bits, so that there are at
most some 100,000 weight classes whatever the input (the proven bound of what
reaches the driver).  Groups of one class are interchangeable, so best-fit
decreasing over (class, count) gives runs "groups lo..hi of this class go to
shard b", and each group finds its run by its number within its class.

``law`` is ``bytes``: the capacity is the least for which the packing needs no
more than the given number of shards, so the byte sums are equal up to the
rounding (below 0.05 %) and the grain of the groups.  A group heavier than an even share gets a
shard of its own, and the others share the rest evenly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, number_within, read_table, text_or_empty

#: Rows that one numbering task takes, about.
ROWS_PER_BUCKET = 10_000


# ---------------------------------------------------------------- balanced tree

@dataclass(slots=True)
class _Node:
    key: tuple[int, int]
    left: "_Node | None" = None
    right: "_Node | None" = None
    height: int = 1


def _h(n: _Node | None) -> int:
    return n.height if n else 0


def _rotate(n: _Node, side: str) -> _Node:
    """Lift the child on ``side`` above ``n``."""
    other = "right" if side == "left" else "left"
    up = getattr(n, side)
    setattr(n, side, getattr(up, other))
    setattr(up, other, n)
    for x in (n, up):
        x.height = 1 + max(_h(x.left), _h(x.right))
    return up


def _balance(n: _Node) -> _Node:
    n.height = 1 + max(_h(n.left), _h(n.right))
    for side, other in (("left", "right"), ("right", "left")):
        child = getattr(n, side)
        if _h(child) > _h(getattr(n, other)) + 1:
            if _h(getattr(child, other)) > _h(getattr(child, side)):
                setattr(n, side, _rotate(child, other))
            return _rotate(n, side)
    return n


class CapacityTree:
    """Height-balanced search tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def insert(self, key: tuple[int, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return _balance(n)
        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(n: _Node, k: tuple[int, int]) -> _Node | None:
            if k < n.key:
                n.left = cut(n.left, k)
            elif k > n.key:
                n.right = cut(n.right, k)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key, n.right = least.key, cut(n.right, least.key)
            return _balance(n)
        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least remaining capacity that holds ``size``."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int,
                        most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Pack (weight, count) classes into bins of ``capacity``.

    Returns the runs (weight, lo, hi, bin) and the number of bins, or None if
    more than ``most`` bins would be needed.  A bin that took an item of a
    class is still the tightest for the next one of the class, so it takes as
    many as it can hold in one step.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for weight, count in sorted(classes, reverse=True):
        done = 0
        while done < count:
            room = tree.tightest(weight)
            if room is None:
                if bins == most or weight > capacity:
                    return None
                room = (capacity, bins)
                bins += 1
            else:
                tree.remove(room)
            take = min(count - done, room[0] // weight)
            runs.append((weight, done, done + take, room[1]))
            done += take
            if left := room[0] - take * weight:
                tree.insert((left, room[1]))
    return runs, bins


def plan_shards(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (weight, lo, hi, shard) over exactly ``shards`` shards of near-equal sums.

    Classes above the even share take one shard each; for the rest the least
    capacity that needs no more than the shards left is found by bisection.
    """
    left = {w: c for w, c in classes}
    runs: list[tuple[int, int, int, int]] = []
    used = 0
    for weight in sorted(left, reverse=True):
        total = sum(w * c for w, c in left.items())
        taken = 0
        while left[weight] and shards - used > 1 and weight * (shards - used) > total:
            runs.append((weight, taken, taken + 1, used))
            used, taken, total = used + 1, taken + 1, total - weight
            left[weight] -= 1
        if left[weight]:
            break
        del left[weight]
    offset = {runs[-1][0]: runs[-1][2]} if runs else {}
    rest = [(w, c) for w, c in left.items() if c]
    if not rest:
        return runs
    n, total = shards - used, sum(w * c for w, c in rest)
    low = max(-(-total // n), max(w for w, _ in rest))
    step, high = 1, low
    while (found := best_fit_decreasing(rest, high, n)) is None:
        high, step = high + step, step * 2
    low = high - step // 2
    while low < high:
        mid = (low + high) // 2
        if better := best_fit_decreasing(rest, mid, n):
            found, high = better, mid
        else:
            low = mid + 1
    return runs + [(w, lo + offset.get(w, 0), hi + offset.get(w, 0), b + used) for w, lo, hi, b in found[0]]


# ---------------------------------------------------------------- on tables

def _weight_class():
    """The weight rounded up to 12 significant bits."""
    unit = F.expr("shiftleft(1L, greatest(0, length(bin(weight)) - 12))")
    return (F.floor((F.col("weight") + unit - 1) / unit) * unit).cast("long")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: (id_col, size, text_crc32, shard, slot, group_key).

    ``size`` is the UTF-8 length plus 8.  A null text counts as empty and goes
    with the empty texts; repeated rows and null ids are kept, each with a slot
    of its own.  An empty table gives no rows.  Columns other than ``id_col``
    and ``text_col`` are not read, so their names don't matter.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_or_empty(text_col)
    rows = materialise(docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group_key"),
    ), "shard-rows")
    groups = materialise(
        rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("weight"))
        .withColumn("weight_class", _weight_class()),
        "shard-groups")
    classes = groups.groupBy("weight_class").agg(F.count(F.lit(1)), F.sum("copies")).collect()
    n_groups, n_rows = sum(c[1] for c in classes), sum(c[2] for c in classes)
    runs = groups.sparkSession.createDataFrame(
        plan_shards([(c[0], c[1]) for c in classes], shards),
        "weight_class long, lo long, hi long, shard int")
    numbered = number_within(groups, ["weight_class"], ["group_key"], "place", 1 + n_groups // ROWS_PER_BUCKET)
    # At most a run for each class and shard: small whatever the input.
    placed = (
        numbered.join(F.broadcast(runs), "weight_class")
        .where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        .select("group_key", "shard")
    )
    sharded = materialise(rows.join(placed, "group_key"), "shard-placed")
    return (
        number_within(sharded, ["shard"], ["_id", "group_key"], "slot", 1 + n_rows // ROWS_PER_BUCKET)
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot", "group_key")
    )


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 23, near equal in bytes, equal texts together."""
    out = shard_documents(read_table(spark, sf_dir, "documents"), 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
