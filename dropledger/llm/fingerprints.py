"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text where the hash plus one
is a multiple of the block size, so cuts depend on the content near them only
and an edit disturbs few chunks.  Block sizes are 3, 6, 12 …; a text takes the
smallest that gives it at most ``MOST_CHUNKS`` chunks.  Each chunk of the
whole text becomes one symbol (12 bits of its CRC, two characters), and the
fingerprint is ``size:symbols at size:symbols at twice the size``.

Two fingerprints are compared where they share a block size: the likeness is
1 - D / (l + m) for symbol sequences of lengths l and m at edit distance D
(insertions and deletions), the greater of two where both sizes are shared.

Pairs of neighbours in id order: rows are dealt to ranges of the id, each
sorted in one task that keeps the row before; the first rows of all ranges
(one for each task) also go to the end of the range before.  So the texts are
shuffled once and no window runs over the whole table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import prepare, read_table, text_or_empty

WINDOW = 7
SMALLEST = 3
MOST_CHUNKS = 64
#: Texts hashed together, by bytes.
HASH_BYTES = 1 << 20
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOLS = [a + b for a in DIGITS for b in DIGITS]


# ---------------------------------------------------------------- fingerprints

def _levels(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the smallest block size cuts, and how often that size may be doubled there.

    The rolling hash adds the window's sum, its sum weighted by place, and
    the bytes shifted by 5 bits a place and joined by exclusive or.
    """
    x = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    n = len(data)
    total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        byte = x[WINDOW - 1 - back:WINDOW - 1 - back + n]
        total += byte * np.uint32(1 + WINDOW - back)
        mixed ^= byte << np.uint32(5 * back)
    value = (total + mixed).astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(value % np.uint64(SMALLEST) == 0)
    low = value[at] & (~value[at] + np.uint64(1))
    return at, np.bitwise_count(low - np.uint64(1)).astype(np.int64)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprint of each text; texts are hashed together, apart by zeros as before a text's begin."""
    out: list[str] = []
    at = 0
    gap = b"\0" * (WINDOW - 1)
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) <= HASH_BYTES):
            group.append(texts[at])
            size += len(texts[at]) + len(gap)
            at += 1
        places, levels = _levels(np.frombuffer(gap.join(group), np.uint8))
        begin = 0
        for text in group:
            lo, hi = np.searchsorted(places, (begin, begin + len(text)))
            out.append(_signature(text, places[lo:hi] - begin, levels[lo:hi]))
            begin += len(text) + len(gap)
    return out


def _signature(text: bytes, places: np.ndarray, levels: np.ndarray) -> str:
    def cuts_at(level: int) -> list[int]:
        ends = (places[levels >= level] + 1).tolist()
        return ends if ends and ends[-1] == len(text) else [*ends, len(text)]

    def symbols(level: int) -> str:
        if not text:
            return ""
        ends = cuts_at(level)
        return "".join([SYMBOLS[zlib.crc32(text[a:b]) & 4095] for a, b in zip([0, *ends], ends, strict=False)])

    level = 0
    if len(levels) >= MOST_CHUNKS:
        cuts = np.cumsum(np.bincount(levels)[::-1])[::-1]  # by level: cuts at it or above
        small = np.flatnonzero(cuts < MOST_CHUNKS)
        level = int(small[0]) if len(small) else len(cuts)
    return f"{SMALLEST << level}:{symbols(level)}:{symbols(level + 1)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each symbol of ``a``."""
    where: dict[str, int] = {}
    for i, s in enumerate(a):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for s in b:
        met = row & where.get(s, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def likeness(one: str, other: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 where no block size is shared."""
    if one == other:
        return 1.0
    (n, *a), (m, *b) = one.split(":"), other.split(":")
    size, other_size = int(n), int(m)
    if size == other_size:
        pairs = list(zip(a, b, strict=True))
    elif size == 2 * other_size:
        pairs = [(a[0], b[1])]
    elif other_size == 2 * size:
        pairs = [(a[1], b[0])]
    else:
        return 0.0
    best = 0.0
    for x, y in pairs:
        if x and y:
            xs, ys = [x[i:i + 2] for i in range(0, len(x), 2)], [y[i:i + 2] for i in range(0, len(y), 2)]
            distance = len(xs) + len(ys) - 2 * _common(xs, ys)
            best = max(best, 1 - distance / (len(xs) + len(ys)))
    return best


# ---------------------------------------------------------------- on tables

def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _extra) in ranges of the id: sorted partitions, each followed by the next one's first row.

    The last range is followed by the first row of all.  Ids are numbers; null
    ids come first, and rows of equal id in the order of their texts (rows of
    one id stay together).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(F.col(f"`{text_col}`")).alias("_text"))
    least = F.lit(-(1 << 63)).cast("long")
    rows = rows.withColumn("_key", F.coalesce(F.col("_id").cast("long"), least))
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    edges = np.array(sorted(set(cuts)), np.int64)

    def ranged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(np.searchsorted(edges, keys.to_numpy(), "right").astype(np.int32))
    ranged.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}

    rows = rows.withColumn("_range", F.pandas_udf(ranged, "int")("_key"))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("_range").agg(F.min("_key")).collect())  # a row for each task
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    edge_rows = spark.createDataFrame(list(before.items()), "_key long, _range int")
    extra = rows.drop("_range").join(F.broadcast(edge_rows), "_key").select("_id", "_text", "_key", "_range", F.lit(1).alias("_extra"))
    both = rows.select("_id", "_text", "_key", "_range", F.lit(0).alias("_extra")).unionByName(extra)
    return (
        both.repartitionById(len(edges) + 1, "_range")
        .sortWithinPartitions("_range", "_extra", "_key", "_text").select("_id", "_text", "_extra")
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one; a row waits until its next row is there."""
    ids, texts, extras = [], [], []

    def finish(m: int) -> pa.RecordBatch:
        own = texts[:m + 1]
        edited = [t[:len(t) - (k := len(t) // 2)] + u[:k] for t, u in zip(own, own[1:], strict=False)]
        raw = [e.encode() for e in edited]
        prints = fingerprints([t.encode() for t in own])
        changed = fingerprints(raw)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:m], id_type), pa.array([len(t) for t in own[:m]], pa.int64()),
             pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(prints[:m]), pa.array(changed),
             pa.array([likeness(a, b) for a, b in zip(prints, changed, strict=False)], pa.float64()),
             pa.array([likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)], pa.float64())],
            names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for whole in batches:
        id_type = whole.schema.field("_id").type
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            for i, t, e in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(),
                               batch.column("_extra").to_pylist(), strict=True):
                if not (extras and extras[-1]):  # one extra row is enough
                    ids.append(i), texts.append(t), extras.append(e)
            if (m := len(ids) - 1) > 0:
                yield finish(m)
                del ids[:m], texts[:m], extras[:m]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited form, with their likeness.

    The edited text has its last half (code points, rounded down) replaced by
    as much of the next text's begin.  A null text counts as empty (fingerprint
    ``3::``); a single row is its own next; repeated rows and null ids stay;
    other columns aren't read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return with_next(docs, id_col, text_col).mapInArrow(_compared, schema).withColumnRenamed("_id", id_col)


@query("op4_document_fingerprints")
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, compared with the edited and the next text."""
    return compare_neighbours(read_table(spark, sf_dir, "documents"))
