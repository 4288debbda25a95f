"""Conversation prefix trie: shared beginnings of conversations, and what sharing saves.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that begin with it.

1. *Dictionary.*  Different turns (by the SHA-256 of role and text) get a
   number each, so a conversation is a sequence of numbers.  Equal sequences
   are folded to one row with their count and least id.
2. *Shards.*  Distinct sequences are dealt to shards by range in their
   lexicographic order, so a shard holds the sequences below few branches.
3. *Ternary search tree* per shard: a node holds a turn number, links to a
   lesser and a greater turn at the same place, and one to the next place.
   Sequences come sorted and are inserted by medians (the middle one, then the
   middles of both halves), which keeps the links of each place balanced.
   Nodes stand behind the node of the turn before, so one pass backwards over
   them adds up members, leaves and savings.
4. *Boundaries.*  Only nodes on the way of a shard's first and last sequence
   may be in other shards too.  They are merged by a sum: two neighbouring
   shards have in common the nodes of the common prefix of the last and the
   first sequence, so these count one child, the bytes of the way below and,
   where the earlier sequence ends there, one leaf less.

The hash of the ids that end at a node goes over any number of them: ids are
dealt by range of (sequence, id), so a sequence that a third of all
conversations are is written in pieces by many tasks, and only the joined
pieces pass through one hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, prepare, read_table, text_or_empty

#: Ids whose decimal text is one piece of a long list.
PIECE_IDS = 50_000


# ---------------------------------------------------------------- sequences

def turn_sequences(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id long, ids array<long>, sizes array<long>): the turns of each conversation by number, with their bytes.

    Turns are in the order of ``order_col``, null first; equal ones by role,
    then by the turn's digest.  A null role or text is empty.  Turns without an
    id belong to no conversation.
    """
    role, text = text_or_empty(F.col(f"`{role_col}`")), text_or_empty(F.col(f"`{text_col}`"))
    rows = materialise(turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{order_col}`").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.octet_length(text).cast("long").alias("size")), "trie-turns")
    numbers = materialise(
        rows.groupBy("key").agg(F.first("size").alias("size")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    told = rows.select("conv_id", "turn", "role", "key").join(numbers, "key")
    return (
        told.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "id", "size"))).alias("t"))
        .select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))
    )


def with_common_heads(sequences: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Conversations rebuilt so that those of a family of ``family`` ids share their first turns.

    With h the CRC of the decimal id modulo ``most`` + 1, the first h turns
    come from the conversation c - c % family (all if it has fewer, none if it
    isn't there); the own turns from the h-th on follow.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    heads = sequences.where(base == F.col("conv_id")).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1)).cast("int")
    none = F.expr("cast(array() as array<bigint>)")

    def both(own: str, head: str):
        return F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")),
                        F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0))))

    return sequences.withColumn("base", base).withColumn("h", h).join(heads, "base", "left").select(
        "conv_id", both("ids", "head_ids").alias("ids"), both("sizes", "head_sizes").alias("sizes"))


# ---------------------------------------------------------------- ids that end at a node

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) of a range to a hash for each key, or to pieces of text for the first and last key."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    key, ids, outer = None, [], True  # outer: the key at hand may have begun in another range
    out: list[tuple] = []

    def piece() -> None:
        nonlocal number
        out.append((key, part, number, ",".join(map(str, ids)), None))
        number += 1
        ids.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        types = (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          names=["key", "part", "piece", "text", "sha"])

    split = False  # the key at hand has pieces already
    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    if outer or split:
                        if ids:
                            piece()
                    else:
                        out.append((key, None, None, None, hashlib.sha256(",".join(map(str, ids)).encode()).digest()))
                        ids.clear()
                    outer = split = False
                else:
                    outer = True
                key = k
            ids.append(i)
            if len(ids) >= PIECE_IDS:
                piece()
                split = True
        if out:
            yield batch_of(out)
            out = []
    if ids:
        piece()
        yield batch_of(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the hash of each key."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + text.encode())
            else:
                if key is not None:
                    out.append((key, digest.digest()))
                key, digest = k, hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.digest()])], names=["key", "sha"])


def id_hashes(rows: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the ascending ``conv_id`` of each ``key``, comma-joined."""
    pieces = materialise(
        rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInArrow(_pieces, "key binary, part int, piece int, text string, sha binary"), "trie-pieces")
    joined = pieces.where("sha is null").repartition("key").sortWithinPartitions("key", "part", "piece").mapInArrow(
        _joined, "key binary, sha binary")
    return pieces.where("sha is not null").select("key", "sha").unionByName(joined)


# ---------------------------------------------------------------- ternary search trees

class TernaryTree:
    """Ternary search tree over sequences of numbers; node 0 is the textless root.

    Lists by node: ``turn``, ``less``, ``more`` and ``first`` (the links),
    ``up`` (node of the turn before), ``size`` (bytes), ``depth``.
    """

    def __init__(self) -> None:
        self.turn, self.less, self.more, self.first = [-1], [0], [0], [0]
        self.up, self.size, self.depth = [-1], [0], [0]

    def _new(self, turn: int, size: int, up: int) -> int:
        for column, value in ((self.turn, turn), (self.less, 0), (self.more, 0), (self.first, 0), (self.up, up),
                              (self.size, size), (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node of the whole sequence."""
        at = 0
        for turn, size in zip(ids, sizes, strict=True):
            node = self.first[at]
            if not node:
                node = self.first[at] = self._new(turn, size, at)
            while turn != self.turn[node]:
                links = self.less if turn < self.turn[node] else self.more
                if not links[node]:
                    links[node] = self._new(turn, size, at)
                node = links[node]
            at = node
        return at

    def way(self, ids: list[int]) -> list[int]:
        """Nodes from the root along a sequence that is there."""
        out = [0]
        for turn in ids:
            node = self.first[out[-1]]
            while turn != self.turn[node]:
                node = self.less[node] if turn < self.turn[node] else self.more[node]
            out.append(node)
        return out


def by_medians(n: int) -> Iterator[int]:
    """0 to n - 1: the middle, then the middles of the halves."""
    spans = [(0, n)]
    for lo, hi in spans:
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            spans.append((lo, middle))
            spans.append((middle + 1, hi))


def prefix_key(ids: list[int], depth: int) -> bytes:
    return hashlib.sha256(np.array(ids[:depth], "<i8").tobytes()).digest()


NODES = ("key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, repeated long, once long, sha binary, part int, first_ids array<long>, last_ids array<long>, "
         "last_sizes array<long>")
_TYPES = (pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 3)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)],
                                      names=[c.split()[0] for c in NODES.split(", ")])


def shard_nodes(rows: list[tuple]) -> tuple[TernaryTree, dict[str, list], list[int], list[int]]:
    """Tree, sums by node, and the ways of the first and the last sequence; rows: sorted (ids, sizes, n, conv_id, sha)."""
    tree, ends = TernaryTree(), {}
    for i in by_medians(len(rows)):
        ends[tree.insert(rows[i][0], rows[i][1])] = i
    n = len(tree.turn)
    convs, least, children, leaves = [0] * n, [None] * n, [0] * n, [0] * n
    repeated, once, sha = [0] * n, [0] * n, [None] * n
    for node in range(n - 1, -1, -1):  # a node stands behind the one of the turn before
        if node in ends:
            _, _, times, conv, sha[node] = rows[ends[node]]
            convs[node] += times
            least[node] = conv if least[node] is None else min(conv, least[node])
        leaves[node] = leaves[node] or 1
        repeated[node] += convs[node] * tree.size[node]
        once[node] += tree.size[node]
        up = tree.up[node]
        if up >= 0:
            convs[up] += convs[node]
            least[up] = least[node] if least[up] is None else min(least[node], least[up])
            children[up] += 1
            leaves[up] += leaves[node]
            repeated[up] += repeated[node]
            once[up] += once[node]
    sums = {"convs": convs, "least": least, "children": children, "leaves": leaves, "repeated": repeated, "once": once, "sha": sha}
    return tree, sums, tree.way(rows[0][0]), tree.way(rows[-1][0])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard of sorted sequences; those that may be in other shards have a ``key``."""
    from pyspark import TaskContext

    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "times", "conv_id", "sha")), strict=True)
    if not rows:
        return
    part = TaskContext.get().partitionId()
    tree, sums, first, last = shard_nodes(rows)
    keys = {node: prefix_key(ids, d) for way, ids in ((first, rows[0][0]), (last, rows[-1][0])) for d, node in enumerate(way)}
    out: list[tuple] = []
    for node in range(len(tree.turn)):
        up = tree.up[node]
        own_parent = up >= 0 and up not in keys
        out.append((
            keys.get(node), None if own_parent or up < 0 else keys[up], sums["least"][node], tree.depth[node],
            sums["least"][up] if own_parent else None, sums["convs"][node], sums["children"][node], sums["leaves"][node],
            sums["repeated"][node], sums["once"][node], sums["sha"][node], None, None, None, None))
        if len(out) >= 20_000:
            yield _node_batch(out)
            out = []
    out.append((*[None] * 11, part, rows[0][0], rows[-1][0], rows[-1][1]))
    yield _node_batch(out)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the nodes common to two neighbouring shards count too much, as negative sums."""
    for batch in batches:
        out: list[tuple] = []
        for ids, last, sizes in zip(*(batch.column(c).to_pylist() for c in ("first_ids", "last_ids", "last_sizes")), strict=True):
            common = 0
            while common < min(len(ids), len(last)) and ids[common] == last[common]:
                common += 1
            below = 0
            for depth in range(common, -1, -1):
                below += sizes[depth - 1] if depth else 0
                out.append((prefix_key(last, depth), prefix_key(last, depth - 1) if depth else None, None, depth, None, 0,
                            -int(depth < common), -int(len(last) == common), 0, -below, None, None, None, None, None))
        if out:
            yield _node_batch(out)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv_id, ids, sizes); conversations without turns end at the root.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): the least member and that of the parent (root:
    null); members, children, childless nodes of the subtree; bytes that
    sharing saves in the subtree; hash of the ids that end here.  An empty
    table has no node, not even a root.
    """
    prepare(sequences.sparkSession)
    key = F.unhex(F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256))
    rows = materialise(sequences.withColumn("key", key), "trie-sequences")
    distinct = rows.groupBy("key").agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("times"), F.min("conv_id").alias("conv_id"))
    shards = distinct.join(id_hashes(rows), "key").select("ids", "sizes", "times", "conv_id", "sha").repartitionByRange(
        "ids").sortWithinPartitions("ids")
    table = materialise(shards.mapInArrow(_shard, NODES), "trie-shards")
    before = Window.orderBy("part")  # a row for each shard
    pairs = table.where("part is not null").select(
        "first_ids", F.lag("last_ids").over(before).alias("last_ids"), F.lag("last_sizes").over(before).alias("last_sizes")
    ).where("last_ids is not null")
    merged = materialise(
        table.where("key is not null").unionByName(pairs.mapInArrow(_seams, NODES)).groupBy("key").agg(
            F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
            *[F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "repeated", "once")],
            F.max("sha").alias("sha")), "trie-boundaries")
    parents = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    own = ["up", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "repeated", "once", "sha"]
    inner = table.where("key is null and part is null")
    open_rows = inner.where("up is not null").select(own).unionByName(
        merged.where("up is not null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(own))
    settled = open_rows.join(parents, "up").withColumn("parent_conv_id", F.col("up_conv")).select(own)
    root = merged.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(own)
    nodes = inner.where("up is null").select(own).unionByName(settled).unionByName(root)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("repeated") - F.col("once")).alias("saved_tokens"),
        F.when(F.col("sha").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, **columns) -> DataFrame:
    """The prefix trie of a table of turns; see ``turn_sequences`` and ``prefix_trie``.

    Nulls and ties: see there.  Repeated rows are turns of their own; long
    texts travel as digests only; other columns aren't read.
    """
    return prefix_trie(turn_sequences(turns, **columns))


@query("op13_conversation_trie")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt with common heads."""
    turns = read_table(spark, sf_dir, "conversations")
    return prefix_trie(with_common_heads(materialise(turn_sequences(turns), "trie-own")))
