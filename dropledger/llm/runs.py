"""Periodic runs of words, found in tiles by period octave.

A run is a stretch of words with smallest period q, at least max(12, 2 q)
words long, that no neighbouring word extends.  Words i with word i = word
i + q follow one another in the *matches* of a run: max(12 - q, q) of them or
more.

Tiles: periods are taken by octave (1 to 7, 8 to 15, 16 to 31 …).  An octave's
tiles stand at the multiples of its step (6 words for the first, else its
least period), and a run of the octave has a multiple of the step among its
matches.  The tile at m reaches a step to the left and, for matches, a step to
the right.  Two Z-functions from its boundary m give, for every period of the
octave, how far matches go on to the right (the text from m against itself)
and to the left (the text before m, read backwards).  What comes out is a
fragment of a run's matches, whole or cut at the tile's ends.

Tiles are solved each by itself.  Those of a text of up to ``LONG`` words are
solved where it was read; longer texts are exploded into rows, a few tiles
each, and dealt to all tasks.  Fragments are then shuffled by document and
period, and those that overlap are stitched.  A period whose block at the
boundary is a power of a shorter one isn't a smallest period, and is dropped
in the tile.

Only tiles that hold some six words twice can have a fragment: these are found
by the previous place of each six words.  Nothing else is skipped.
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

#: Least length of a run in words.
LEAST = 12
#: The octave of the short periods: periods below FIRST, tiles at multiples of STEP (the fewest matches of a run).
FIRST = 8
STEP = 6
#: Words above which a text's tiles are dealt to all tasks, and words of the tiles of one row.
LONG = 200_000
ROW_WORDS = 50_000


# ---------------------------------------------------------------- tiles

def octaves(n: int) -> list[tuple[int, int, int]]:
    """(least period, greatest period, step) for texts of ``n`` words."""
    out = [(1, FIRST - 1, STEP)] if n >= LEAST else []
    low = FIRST
    while 2 * low <= n:
        out.append((low, 2 * low - 1, low))
        low *= 2
    return out


def previous_places(ids: np.ndarray) -> np.ndarray | None:
    """For each place the previous one with the same STEP words, or -1; None if no such words occur twice."""
    n = len(ids) - STEP + 1
    if n < 2:
        return None
    h = np.zeros(n, np.uint64)
    for k in range(STEP):
        h = (h ^ ids[k:k + n].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    return before


def active_tiles(before: np.ndarray, n: int, high: int, step: int) -> np.ndarray:
    """Boundaries of the tiles that hold some STEP words twice."""
    blocks = -(-n // step)
    most = np.full(blocks + 4, -1, np.int64)
    padded = np.full(blocks * step, -1, np.int64)
    padded[:len(before)] = before
    most[1:blocks + 1] = padded.reshape(blocks, step).max(axis=1)
    # A tile reaches from one step before its boundary to step + high words behind it.
    reach = 1 + -(-(step + high) // step)
    latest = np.full(blocks, -1, np.int64)
    for k in range(reach):
        part = most[k:k + blocks]
        np.maximum(latest[:len(part)], part, out=latest[:len(part)])
    at = np.arange(blocks) * step
    return at[latest >= np.maximum(at - step, 0)]


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest prefix of ``s`` that begins there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            z[i] = k
            left, right = i, i + k
    return z


def solve_tile(words: list[int], base: int, n: int, m: int, low: int, high: int, step: int) -> list[tuple[int, int, int]]:
    """Fragments (period, first match, end of matches) at boundary ``m``; ``words`` are those from ``base`` on."""
    high = min(high, n - m - 1)
    if high < low:
        return []
    ahead = words[m - base:m - base + step + high]
    right = z_function(ahead)
    periods = [q for q in range(low, high + 1) if right[q]]
    if not periods:
        return []
    powers = set()
    for d in range(1, high // 2 + 1):
        if right[d] >= d and d not in powers:
            powers.update(range(2 * d, min(d + right[d], high) + 1, d))
    periods = [q for q in periods if q not in powers]
    if not periods:
        return []
    reach = min(step, m)
    pattern = words[m - reach - base:m - base][::-1]
    left = z_function([*pattern, -1, *words[m - reach - base:m + high - base][::-1]])
    out = []
    for q in periods:
        back, on = min(left[reach + 1 + high - q], reach) if reach else 0, min(right[q], step)
        whole = (back < reach or reach == m) and (on < step or m + on + q >= n)
        if not whole or back + on >= max(q, LEAST - q):
            out.append((q, m - back, m + on))
    return out


def word_ids(text: str) -> np.ndarray:
    """Numbers of the words of a text, equal for equal words."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in text.encode().split()], np.int64)


TABLE = ("_row long, _id {id}, n long, text string, collapsed_sha256 string, period int, lo int, hi int, "
         "low int, high int, step int, base int, tiles array<int>, words array<int>")


def _tiles(long: int):
    """Maps (_id, _text) to a row for each document, its fragments and, for long texts, rows of tiles.

    Documents without an active tile have no run: their row has the hash of
    their words; the others' rows have their text.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    number += 1
                    ids = word_ids(text)
                    n, found, kept = len(ids), [], 0
                    before = previous_places(ids)
                    if before is not None:
                        words = ids.tolist()
                        for low, high, step in octaves(n):
                            active = active_tiles(before, n, high, step).tolist()
                            kept += len(active)
                            if n <= long:
                                for m in active:
                                    found += solve_tile(words, 0, n, m, low, high, step)
                            else:
                                for some in _gathered(active, high, step):
                                    base = max(0, some[0] - step)
                                    out.append((number, i, n, None, None, None, None, None, low, high, step, base, some,
                                                words[base:some[-1] + step + high]))
                    if found or (kept and n > long):
                        out.append((number, i, n, text, *[None] * 10))
                        out += [(number, i, n, None, None, q, lo, hi, *[None] * 6) for q, lo, hi in found]
                    else:
                        sha = hashlib.sha256(b" ".join(text.encode().split())).hexdigest()
                        out.append((number, i, n, None, sha, *[None] * 9))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), part.column("_id").take(pa.array(cols[1], pa.int64())), pa.array(cols[2], pa.int64()),
                         pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()),
                         *(pa.array(c, pa.int32()) for c in cols[5:12]), *(pa.array(c, pa.list_(pa.int32())) for c in cols[12:])],
                        names=[c.split()[0] for c in TABLE.split(", ")])

    return rows


def _gathered(active: list[int], high: int, step: int) -> Iterator[list[int]]:
    """Tiles that follow one another, up to ROW_WORDS words together."""
    some: list[int] = []
    for m in active:
        if some and m + step + high - some[0] > max(ROW_WORDS, 2 * (step + high)):
            yield some
            some = []
        some.append(m)
    if some:
        yield some


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of rows of tiles."""
    names = ["_row", "n", "low", "high", "step", "base", "tiles", "words"]
    for batch in batches:
        for at in range(batch.num_rows):
            number, n, low, high, step, base, tiles, words = (batch.column(c)[at].as_py() for c in names)
            found = [f for m in tiles for f in solve_tile(words, base, n, m, low, high, step)]
            if found:
                q, lo, hi = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(q), pa.int64()), pa.array(q, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                    names=["_row", "period", "lo", "hi"])


# ---------------------------------------------------------------- runs

def stitched(fragments: DataFrame) -> DataFrame:
    """(_row, start, length, period) of the runs that the fragments (_row, period, lo, hi) make."""
    by = Window.partitionBy("_row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        fragments.withColumn("new", F.when(before >= F.col("lo"), 0).otherwise(1))
        .withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_row", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
        .where(F.col("hi") - F.col("start") >= F.greatest(F.col("period"), F.lit(LEAST) - F.col("period")))
        .groupBy("_row", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"))
        .agg(F.min("period").alias("period"))
    )


def collapse(text: str, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of ``text`` joined by single blanks, but for those behind the first period of a run (start, length, period)."""
    words = text.encode().split()
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return b" ".join([words[i] for i in kept])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            out = []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                listed = sorted((r["start"], r["length"], r["period"]) for r in runs or ())
                out.append((hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in listed).encode()).hexdigest(),
                            hashlib.sha256(collapse(text, listed)).hexdigest()))
            shas = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("n"), part.column("runs"), pa.array(shas[0]), pa.array(shas[1])],
                names=["_id", "n", "runs", "runs_sha256", "collapsed_sha256"])


RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int | None = None) -> DataFrame:
    """(id_col, n, runs, runs_sha256, collapsed_sha256) of every document.

    ``n`` counts the words (separated by the six ASCII blanks), ``runs`` is an
    array of (start, length, period) in words, without order.  The hashes are
    those of the lines ``start,length,period`` by start, then period, and of
    the collapsed text.  A null or empty text has no words; repeated rows and
    null ids stay; other columns aren't read; an empty table gives no rows.
    Texts of over ``long`` words are solved by all tasks.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(F.col(f"`{text_col}`")).alias("_text"))
    table = materialise(narrow.mapInArrow(_tiles(LONG if long is None else long), TABLE.format(id=id_type)), "run-tiles")
    far = table.where("tiles is not null").select("_row", "n", "low", "high", "step", "base", "tiles", "words").repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_solved, "_row long, period int, lo int, hi int")
    fragments = table.where("period is not null").select("_row", "period", "lo", "hi").unionByName(far)
    runs = stitched(fragments).groupBy("_row").agg(F.collect_list(F.struct(
        *[F.col(c).cast("long").alias(c) for c in ("start", "length", "period")])).alias("runs"))
    schema = f"_id {id_type}, n long, runs {RUNS}, runs_sha256 string, collapsed_sha256 string"
    some = table.where("text is not null").select("_row", "_id", "n", "text").join(runs, "_row", "left").select(
        "_id", "n", "text", F.coalesce("runs", F.expr(f"cast(array() as {RUNS})")).alias("runs")).mapInArrow(_finished, schema)
    none = table.where("collapsed_sha256 is not null").select(
        "_id", "n", F.expr(f"cast(array() as {RUNS})").alias("runs"), F.sha2(F.lit(""), 256).alias("runs_sha256"), "collapsed_sha256")
    return none.unionByName(some).withColumnRenamed("_id", id_col)


def with_repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which every tenth text (by the CRC of its id) repeats a block of its words from some word on.

    With h the CRC of the decimal id (null: never chosen) and g = h div 10,
    texts with h % 10 = 0 keep their words up to a = g % n, and go on with the
    next p = 1 + (n - a) div (3 + g % 8) words again and again, up to n words.
    """
    text = F.col(f"`{text_col}`")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.withColumn("_h", F.crc32(F.col(f"`{id_col}`").cast("string"))).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, words))
    parts = parts.withColumn("_a", F.expr("(_h div 10) % nullif(size(_words), 0)")).withColumn(
        "_p", F.expr("1 + (size(_words) - _a) div (3 + (_h div 10) % 8)"))
    tail = F.expr("transform(sequence(0, size(_words) - 1), i -> _words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)])")
    return parts.withColumn(text_col, F.when(F.size("_words") > 0, F.array_join(tail, " ")).otherwise(text)).drop(
        "_h", "_words", "_a", "_p")


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth with a repeated tail."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(with_repeated_tail(docs))
    longest = F.expr("""
        aggregate(runs, cast(null as struct<start:long,length:long,period:long>),
          (a, x) -> if(a is null or x.length > a.length or (x.length = a.length and
            (x.start < a.start or (x.start = a.start and x.period < a.period))), x, a))""")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
