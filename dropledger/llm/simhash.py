"""SimHash near-dedup: fingerprints, and links by a binary trie self-join.

Fingerprint: majority bits of the XXH64 hashes of a text's word shingles.
Rows are first folded to one row for each different fingerprint, so copies
never form pairs.

Links (at most ``BUDGET`` differing bits) come from a trie over the bits of
the fingerprints, traversed against itself: a pair of trie nodes of one depth
carries the bits in which their prefixes differ; both sides go one bit down,
and pairs over the budget are pruned.  To spread this over tasks, the 64 bits
are cut into ``BUDGET + 1`` blocks: two linked fingerprints agree in a whole
block, so with that block rotated to the top they meet below one trie node,
and each such node is a task of its own.  A node with more than ``MOST_ROWS``
fingerprints is split into pairs of its descendants a few bits further down
(again only pairs within the budget), until all tasks are small; no
fingerprint is left out.  A task keeps its fingerprints as sorted arrays, a
node as a range of them, and works down its frontier of node pairs in slices
of bounded size; of the links it returns the spanning stars.

Components: large-star and small-star rounds over the stars, each written to
the shared folder, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, prepare, read_table, text_or_empty

WIDTH = 3
BUDGET = 2
SEED = 42
#: (rotation to the left, bits) of the blocks that are brought to the top.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Depth from which all tasks traverse; above it the fingerprints of a task are equal or already told apart.
TOP = 21
#: Fingerprints in one task at most, bits by which a larger one is split, node pairs held at once.
MOST_ROWS = 100_000
SPLIT_BITS = 4
FRONTIER = 1 << 18
#: Rows that small tasks are gathered up to before they are traversed together.
CHUNK_ROWS = 20_000


# ---------------------------------------------------------------- fingerprints

def simhash(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the ASCII blanks only
    if not words:
        return 0
    if len(words) > width:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
        n = len(words) - width + 1
    else:
        shingles, n = [b" ".join(words)], 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint as a (signed) long."""
    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            prints = np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))
    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "long")(text)


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


# ---------------------------------------------------------------- trie self-join

def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the index of its root) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def linked_pairs(keys: np.ndarray, nodes: np.ndarray, budget: int = BUDGET,
                 top: int = TOP, most: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` within ``budget`` differing bits.

    ``nodes`` has rows (lo, hi, lo, hi): pairs of ranges of ``keys``, each
    range sorted and sharing its first bits or at least its task.  A range
    paired with itself gives each pair once.
    """
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(bit: int) -> np.ndarray:
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0))).astype(np.int32)
        return zeros[bit]

    stack = [(63 - top, nodes.astype(np.int32), np.zeros(len(nodes), np.int8))]
    while stack:
        bit, pairs, bits_off = stack.pop()
        if bit < 0:
            own = pairs[:, 0] != pairs[:, 2]
            yield pairs[own, 0], pairs[own, 2]
            continue
        if len(pairs) > most:
            half = len(pairs) // 2
            stack += [(bit, pairs[half:], bits_off[half:]), (bit, pairs[:half], bits_off[:half])]
            continue
        z = zeros_before(bit)
        a0, a1, b0, b1 = pairs.T
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = a0 == b0
        down = [
            (a0, am, b0, bm, bits_off, None), (am, a1, bm, b1, bits_off, None),
            (a0, am, bm, b1, bits_off + 1, None), (am, a1, b0, bm, bits_off + 1, ~same),
        ]
        kept, off = [], []
        for lo, hi, lo2, hi2, d, only in down:
            ok = (lo < hi) & (lo2 < hi2) & (d <= budget)
            if only is not None:
                ok &= only
            ok &= (lo != lo2) | (hi - lo > 1)  # one fingerprint has no pair with itself
            kept.append(np.column_stack((lo[ok], hi[ok], lo2[ok], hi2[ok])))
            off.append(d[ok])
        pairs = np.concatenate(kept)
        if len(pairs):
            stack.append((bit - 1, pairs, np.concatenate(off)))


def _stars(chunk: pd.DataFrame) -> pd.DataFrame:
    """Spanning stars (fp, root) of the links within the tasks of ``chunk``."""
    chunk = chunk.assign(key=chunk["key"].to_numpy().view(np.uint64))
    chunk = chunk.sort_values(["rot", "pa", "pb", "side", "key"], kind="stable", ignore_index=True)
    task = chunk[["rot", "pa", "pb"]].ne(chunk[["rot", "pa", "pb"]].shift()).any(axis=1).cumsum().to_numpy()
    runs = np.flatnonzero(np.diff(task * 2 + chunk["side"].to_numpy(), prepend=-1))
    ends = np.append(runs[1:], len(chunk))
    nodes = []
    for at, (lo, hi) in enumerate(zip(runs, ends, strict=True)):
        if chunk["pa"].iat[lo] == chunk["pb"].iat[lo]:
            nodes.append((lo, hi, lo, hi))
        elif at + 1 < len(runs) and task[runs[at + 1]] == task[lo]:
            nodes.append((lo, hi, runs[at + 1], ends[at + 1]))
    prints, place = np.unique(chunk["fp"].to_numpy(), return_inverse=True)
    label = np.arange(len(prints))
    if nodes:
        for a, b in linked_pairs(chunk["key"].to_numpy(), np.array(nodes)):
            label = _unite(label, place[a], place[b])
    far = label != np.arange(len(prints))
    return pd.DataFrame({"fp": prints[far], "root": prints[label[far]]})


def _traverse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of each task; tasks come one after the other, and several are traversed together."""
    held: list[pd.DataFrame] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows < CHUNK_ROWS:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = whole[["rot", "pa", "pb"]].iloc[-1]
        open_task = (whole[["rot", "pa", "pb"]] == last).all(axis=1)  # may go on in the next batch
        if not open_task.all():
            yield _stars(whole[~open_task])
        held = [whole[open_task]]
        rows = len(held[0])
    if held and (whole := pd.concat(held, ignore_index=True)).size:
        yield _stars(whole)


def _tasks(classes: DataFrame) -> DataFrame:
    """Fingerprints by task (rot, pa, pb) and side; large tasks split into pairs of descendants."""
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("rot"), F.lit(s).alias("turn"), F.lit(b).alias("depth"))
                                 for i, (s, b) in enumerate(BLOCKS)]))
    rows = (
        classes.select("fp", blocks.alias("b")).select("fp", "b.*")
        .withColumn("key", F.expr("if(turn = 0, fp, shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn))"))
        .withColumn("pa", F.expr("shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth)"))
        .withColumn("pb", F.col("pa"))
        .select("fp", "rot", "key", "depth", "pa", "pb", F.lit(0).alias("side"), F.lit(BUDGET).alias("budget"))
    )

    def at(base: str, number: str) -> str:
        return f"({base} | shiftleft(cast({number} as bigint), 64 - depth - {SPLIT_BITS}))"

    done = []
    ids = ["rot", "pa", "pb"]
    while True:
        sizes = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides"))
        sizes = sizes.where("n > 1 AND (pa = pb OR sides = 2)").select(*ids, "n")
        rows = materialise(rows.join(sizes, ids), "simhash-tasks")
        done.append(rows.where(F.col("n") <= MOST_ROWS).drop("n"))
        large = rows.where(F.col("n") > MOST_ROWS).drop("n")
        if large.isEmpty():
            break
        # Each row goes to all pairs of its child node with a child of the other side within the budget.
        child = F.expr(f"cast(shiftrightunsigned(shiftleft(key, depth), {64 - SPLIT_BITS}) as int)")
        others = F.expr(f"filter(transform(sequence(0, {2 ** SPLIT_BITS - 1}), y -> named_struct('y', y, "
                        "'off', bit_count(child ^ y))), o -> o.off <= budget)")
        rows = (
            large.withColumn("child", child).withColumn("o", F.explode(others))
            .withColumn("first", F.expr("if(pa = pb, child <= o.y, side = 0)"))
            .select(
                "fp", "rot", "key", (F.col("depth") + SPLIT_BITS).alias("depth"),
                F.expr(f"if(first, {at('pa', 'child')}, {at('pa', 'o.y')})").alias("pa"),
                F.expr(f"if(first, {at('pb', 'o.y')}, {at('pb', 'child')})").alias("pb"),
                F.expr("if(first, 0, 1)").alias("side"), (F.col("budget") - F.col("o.off")).alias("budget"))
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("fp", "rot", "key", "pa", "pb", "side")


def _components(edges: DataFrame) -> DataFrame:
    """(fp, root): root is the smallest fingerprint reachable; for all fingerprints that have a link."""
    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        e = both(e)
        least = e.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        return e.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return (
            e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = materialise(edges.select(F.col("fp").alias("u"), F.col("root").alias("v")).distinct(), "simhash-links")
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = materialise(small_star(large_star(edges)), "simhash-stars")
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def component_roots(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, first) for each fingerprint of ``prints`` (id_col, fp).

    ``root`` names the component; ``first`` is its first row, (none, id, fp)
    with the smallest id, null ids last.
    """
    classes = materialise(
        prints.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))).alias("least")),
        "simhash-classes")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = (
        _tasks(classes).repartition(n, "rot", "pa", "pb").sortWithinPartitions("rot", "pa", "pb")
        .mapInPandas(_traverse, "fp long, root long")
    )
    rooted = classes.join(_components(links), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min(F.struct("least.none", "least.id", "fp")).alias("first"))
    return rooted.join(first, "root").select("fp", "root", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, fp, component_id) of every row; ``component_id`` is the smallest id reachable by links.

    A null text counts as empty; texts without words have fingerprint 0 and
    are linked like any other.  Repeated rows and null ids stay (a component
    of null ids only has a null id); other columns aren't read.
    """
    prepare(docs.sparkSession)
    prints = materialise(
        docs.select(F.col(id_col).alias("_id"), fingerprint(text_or_empty(F.col(f"`{text_col}`")), width).alias("fp")),
        "simhash-prints")
    roots = component_roots(prints, "_id").select("fp", F.col("first.id").alias("component_id"))
    return prints.join(roots, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         width: int = WIDTH) -> DataFrame:
    """``docs`` with one row for each component: that with the smallest id.

    Of several rows with that id the one with the least fingerprint, then text
    stays.  The texts are shuffled once, by fingerprint and id, and not
    written in between: their fingerprints are computed again instead.
    """
    prepare(docs.sparkSession)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    printed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), own.alias("_id"),
        fingerprint(text_or_empty(text), width).alias("_fp"), F.coalesce(own.cast("string"), F.lit("")).alias("_key"),
        own.isNull().alias("_none"))
    prints = materialise(printed.select("_id", F.col("_fp").alias("fp")), "simhash-prints")
    keep = component_roots(prints, "_id").groupBy("root").agg(F.any_value("first").alias("first")).select(
        F.col("first.fp").alias("_fp"), F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("_key"),
        F.col("first.none").alias("_none"))
    again = Window.partitionBy("_fp", "_key", "_none").orderBy(F.col("_own").getField(text_col))
    return (
        printed.drop("_id").join(keep, ["_fp", "_key", "_none"])
        .withColumn("_again", F.row_number().over(again)).where("_again = 1")
        .select(*[F.col("_own").getField(c).alias(c) for c in docs.columns])
    )


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
