"""Suffix-array dedup: bytes covered by a string that also starts elsewhere.

A byte goes if a string of ``least`` bytes covers it that starts at two places
of the corpus, in one text or in two.  The repeats come from suffix arrays
built by Lyndon grouping (``lyndon_suffix_array``): suffixes are grouped by
their Lyndon prefixes, in descending order of the groups, by pointers to the
previous smaller suffix; one ascending sweep along the same pointers emits the
order of every group.  There is no renaming and no recursion.

One suffix array over the corpus doesn't fit a task, so suffixes that can
share a string meet by content:

1. *Anchors.*  Each string of ``least`` bytes has one anchor: of its 32-byte
   grams the leftmost with the least hash.  Equal strings have it at the same
   place.  Strings of a text with the same anchor follow one another, so an
   anchor stands for a stretch of the text, its context.  Anchors travel as
   (gram hash, context hash, text, place), without text.
2. *Marks.*  These rows are dealt by range, so a gram that is everywhere is
   cut at any row.  Contexts that occur twice are covered whole; what a gram
   shares between different contexts must be looked at.  Groups cut by a
   range border are settled by a table of the borders, a few rows a task.
3. *Suffix arrays.*  One copy of each different context goes to the task of
   its gram.  A context is written as the edges of two compact tries that
   grow from the anchor: to the left, read backwards, and to the right.
   Contexts that agree up to some byte share the edges up to it, so a context
   is a few symbols instead of some 300 bytes, and none of its branching
   points is lost.  In the suffix array of all these sequences the longest
   match of a suffix stands beside it; where it holds ``least`` bytes, they
   are covered.
4. *Cut.*  The intervals of a text are joined with it, merged and cut out.

A gram with more than ``MOST_CONTEXTS`` different contexts isn't one task's
work.  Its strings are compared by 128-bit hashes instead (a row each,
aggregated before the shuffle); nothing is dropped.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, prepare, read_table, text_or_empty

LEAST = 200
#: Bytes of a gram; a power of two.
GRAM = 32
#: Different contexts of one gram that one task sorts.
MOST_CONTEXTS = 10_000
#: Contexts whose suffix array is built at once (whole grams).
BATCH_CONTEXTS = 4_000
#: Bytes of text hashed at once, and grams whose places fit 16 bits.
HASH_BYTES = 1 << 20
WINDOW_PLACES = 1 << 16


# ---------------------------------------------------------------- suffix array

def lyndon_suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of integers; the end of the sequence is smaller than any symbol.

    Phase 1 keeps all suffixes in groups, at first by their first symbol, and
    takes the groups from the greatest to the least.  When a group's turn
    comes, its members share their Lyndon prefix.  Each member points to the
    previous suffix of a smaller group; what is pointed at goes on with this
    prefix, so it moves up behind the rest of its own group, those with more
    pointers further.  Phase 2 goes through the order from the least suffix:
    the suffix before a placed one is the next of its group, and so are those
    along its pointers up to one that is placed.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    _, ranks, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    ranks, starts = ranks.ravel(), np.concatenate(([1], 1 + np.cumsum(counts)[:-1]))
    sorted_by_first = np.concatenate(([n], np.argsort(ranks, kind="stable")))
    places, sizes = np.empty(n + 1, np.int64), np.zeros(n + 2, np.int64)
    places[sorted_by_first] = np.arange(n + 1)
    sizes[0], sizes[starts] = 1, counts
    order, place, size = _numbers(sorted_by_first), _numbers(places), _numbers(sizes)
    group = _numbers(np.append(starts[ranks], 0))  # where a suffix's group begins; suffix n is the end of the sequence
    before = _numbers(np.full(n + 1, -1))
    end = n + 1
    while end > 0:
        start = group[order[end - 1]]
        pointers: dict[int, int] = {}
        for suffix in sorted(order[start:end]):
            p = suffix - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[suffix] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, times in pointers.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            _move_up([p for p in by_count[times] if size[group[p]] > 1], group, size, order, place)
        end = start

    result, placed, free = _numbers(np.full(n + 1, n)), bytearray(n + 1), _numbers(np.arange(n + 2))
    for at in range(n + 1):
        suffix = result[at] - 1
        while suffix >= 0 and not placed[suffix]:
            own = group[suffix]
            result[free[own]] = suffix
            free[own] += 1
            placed[suffix] = 1
            suffix = before[suffix]
    return np.frombuffer(result, np.int64)[1:]


def _numbers(values: np.ndarray) -> array:
    """8 bytes a number, and quicker to index from Python than numpy."""
    return array("q", values.astype(np.int64).tobytes())


def _move_up(moved: list[int], group: array, size: array, order: array, place: array) -> None:
    """Make those of ``moved`` that share a group a group of their own, behind the rest of it."""
    for p in moved:
        size[group[p]] -= 1
        to = group[p] + size[group[p]]
        at, other = place[p], order[to]
        order[at], order[to] = other, p
        place[other], place[p] = at, to
    for p, new in zip(moved, [group[p] + size[group[p]] for p in moved], strict=True):
        group[p] = new
        size[new] += 1


# ---------------------------------------------------------------- anchors

def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram that begins at each byte, by doubling."""
    h = data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = (h[:-width] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[width:] + (h[width:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        width *= 2
    return h


def _window_least(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of each run of ``window`` keys: the lesser of a block's suffix and the next one's prefix."""
    n = len(keys) - window + 1
    padded = np.full(-(-len(keys) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1:window - 1 + n])


def anchors(data: np.ndarray, least: int) -> np.ndarray:
    """The anchor of each string of ``least`` bytes: its leftmost gram of least hash (of 48 bits)."""
    window = least - GRAM + 1
    hashes = _gram_hashes(data)
    out = []
    for at in range(0, len(data) - least + 1, WINDOW_PLACES - window + 1):
        part = hashes[at:at + WINDOW_PLACES] & np.uint64(0xFFFFFFFFFFFF0000)
        keys = part | np.arange(len(part), dtype=np.uint64)
        out.append((_window_least(keys, window) & np.uint64(0xFFFF)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _contexts(texts: list[bytes], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, gram hash, context hash, anchor, first string, last string) of every context, as (index, …)."""
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= HASH_BYTES):
            total += len(texts[upto])
            upto += 1
        data = b"".join(texts[at:upto])
        if len(data) >= least:
            sizes = np.array([len(t) for t in texts[at:upto]], np.int64)
            ends = np.cumsum(sizes)
            flat = np.frombuffer(data, np.uint8)
            of = anchors(flat, least)
            starts = np.arange(len(of))
            doc = np.searchsorted(ends, starts, "right")
            inside = starts + least <= ends[doc]
            of, starts, doc = of[inside], starts[inside], doc[inside]
            if len(of):
                new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1]))))
                last = np.concatenate((new[1:], [len(of)])) - 1
                grams = _gram_hashes(flat)[of[new]].view(np.int64)
                begin = (ends - sizes)[doc[new]]
                for d, gram, anchor, first, end, base in zip(
                        (doc[new] + at).tolist(), grams.tolist(), of[new].tolist(), starts[new].tolist(),
                        starts[last].tolist(), begin.tolist(), strict=True):
                    # The place of the anchor is part of the context: equal bytes have it at the same place anyway.
                    context = xxhash.xxh3_64_intdigest(data[first:end + least])
                    yield d, gram, context - (1 << 63), anchor - base, first - base, end - base
        at = upto


def anchor_rows(docs: DataFrame, least: int) -> DataFrame:
    """(gram, context, doc, anchor, first, last) of every context of the texts ``_text``; ``doc`` is a text's MD5."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                texts = [t.encode() for t in batch.column("_text").slice(at, 2_000).to_pylist()]
                found = list(zip(*_contexts(texts, least), strict=True))
                if found:
                    names = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
                    doc, gram, context, anchor, first, last = (np.array(c, np.int64) for c in found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram), pa.array(context), names.take(pa.array(doc)),
                         *(pa.array(c.astype(np.int32)) for c in (anchor, first, last))],
                        names=["gram", "context", "doc", "anchor", "first", "last"])

    return docs.select("_text").mapInArrow(
        rows, "gram long, context long, doc binary, anchor int, first int, last int")


# ---------------------------------------------------------------- marks

MARKS = ("gram long, context long, doc binary, anchor int, first int, last int, covered boolean, wanted boolean, "
         "lead boolean, mixed boolean, open boolean, part int, times long, low long, high long")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a range of sorted anchor rows (a bounded number: ranges are even).

    ``covered``: the context is there again; ``wanted``: the first row of a
    context (its lead) whose gram has others.  The first and last groups of a
    range may go on in other ranges.  What that leaves open is a few rows a
    range (``open``: whether a context of one row has more, and whether a lead
    is the only one of its gram or not the first); they get ``lead`` and
    ``mixed`` as far as the range knows.  The first and last context also give
    a row without ``doc`` for the table of the borders.
    """
    from pyspark import TaskContext

    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    whole = pa.Table.from_batches(rows).combine_chunks()
    n = whole.num_rows
    gram, context = whole.column("gram").to_numpy(), whole.column("context").to_numpy()
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    lead = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
    gram_at, context_at = np.flatnonzero(new_gram), np.flatnonzero(lead)
    of_gram, of_context = np.cumsum(new_gram) - 1, np.cumsum(lead) - 1
    gram_end = np.concatenate((gram_at[1:], [n]))
    times = np.diff(np.concatenate((context_at, [n])))
    low, high = context[gram_at], context[gram_end - 1]
    twice, mixed = (times > 1)[of_context], (low != high)[of_gram]
    open_gram = (of_gram == 0) | (of_gram == of_gram[-1])
    open_context = (of_context == 0) | (of_context == of_context[-1])
    unsettled = (open_context & ~twice) | (lead & ((open_gram & ~mixed) | open_context))
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in MARKS.split(", ")]

    keep = np.flatnonzero(twice | (mixed & lead) | unsettled)
    flags = (twice, mixed & lead, lead, mixed, unsettled)
    yield pa.RecordBatch.from_arrays(
        [*(whole.column(c).take(pa.array(keep)).combine_chunks() for c in names[:6]), *(pa.array(x[keep]) for x in flags),
         pa.array(np.full(len(keep), part, np.int32)), *[pa.nulls(len(keep), pa.int64())] * 3], names=names)
    edge = sorted({0, len(context_at) - 1})
    at = context_at[edge]
    none = [pa.nulls(len(at), t) for t in (pa.binary(), *[pa.int32()] * 3, *[pa.bool_()] * 5)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(gram[at]), pa.array(context[at]), *none, pa.array(np.full(len(at), part, np.int32)),
         pa.array(times[edge]), pa.array(low[of_gram[at]]), pa.array(high[of_gram[at]])], names=names)


def marked_contexts(docs: DataFrame, least: int) -> DataFrame:
    """(gram, doc, anchor, first, last, covered, wanted) of the contexts whose bytes are covered or must be looked at.

    ``covered``: the context occurs twice; ``wanted``: it is the lead of a
    context whose gram has others.
    """
    ranged = anchor_rows(docs, least).repartitionByRange("gram", "context", "doc", "anchor").sortWithinPartitions(
        "gram", "context", "doc", "anchor")
    marks = materialise(ranged.mapInArrow(_mark, MARKS), "suffix-marks")
    borders = marks.where("doc is null")  # two rows for each range at most
    grams = borders.groupBy("gram").agg((F.min("low") != F.max("high")).alias("_mixed"))
    contexts = borders.groupBy("gram", "context").agg((F.sum("times") > 1).alias("_twice"), F.min("part").alias("_part"))
    first = F.col("_part").isNull() | (F.col("part") == F.col("_part"))
    settled = (
        marks.where("doc is not null and open")
        .join(F.broadcast(grams), "gram").join(F.broadcast(contexts), ["gram", "context"], "left")
        .withColumn("covered", F.col("covered") | F.coalesce("_twice", F.lit(False)))
        .withColumn("wanted", F.col("lead") & first & (F.col("mixed") | F.col("_mixed")))
    )
    own = ["gram", "doc", "anchor", "first", "last", "covered", "wanted"]
    return marks.where("doc is not null and not open").select(own).unionByName(settled.select(own)).where("covered or wanted")


# ---------------------------------------------------------------- contexts to intervals

def _trie_paths(bucket: np.ndarray, strings: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
    """Of each string the branching points on its way through the compact trie of its bucket: (numbers, depths).

    Strings are sorted; the common prefixes of neighbours give the tree.  The
    way to a string's own leaf isn't listed.
    """
    n = len(strings)
    keys = [b.to_bytes(8, "big") + s for b, s in zip(bucket.tolist(), strings, strict=True)]
    order = sorted(range(n), key=keys.__getitem__)
    sizes = np.array([len(s) for s in strings], np.int64)
    width = int(sizes.max()) if n else 0
    table = np.zeros((n, width + 1), np.uint8)
    filled = np.arange(width + 1) < sizes[:, None]
    table[filled] = np.frombuffer(b"".join(strings), np.uint8)
    by = np.array(order, np.int64)
    a, b = by[:-1], by[1:]
    same = table[a] == table[b]
    same[:, width] = False
    common = np.minimum(np.argmin(same, axis=1), np.minimum(sizes[a], sizes[b]))
    common[bucket[a] != bucket[b]] = 0
    paths: list[list[int]] = [[]] * n
    depths: list[list[int]] = [[]] * n
    begins = _branch_numbers(common.tolist())
    path: list[int] = []
    depth: list[int] = []
    for at, row in enumerate(order):
        while depth and depth[-1] > (common[at - 1] if at else 0):
            path.pop()
            depth.pop()
        for number, deep in begins[at]:
            path.append(number)
            depth.append(deep)
        paths[row], depths[row] = path.copy(), depth.copy()
    return paths, depths


def _branch_numbers(common: list[int]) -> list[list[tuple[int, int]]]:
    """For each leaf the branching points (number, depth) that begin with it, the shallowest first."""
    begins: list[list[tuple[int, int]]] = [[] for _ in range(len(common) + 1)]
    stack: list[tuple[int, int]] = []  # (depth, first leaf)
    number = 0
    for at, d in enumerate([*common, 0]):
        first = at
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            number += 1
            begins[first].append((number, depth))
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    for points in begins:
        points.sort(key=lambda x: x[1])
    return begins


def covered_parts(bucket: np.ndarray, left: list[bytes], right: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context how many bytes before and behind its anchor are covered by shared strings (0, 0: none).

    ``left``: the bytes before the anchor, read backwards; ``right``: those
    from the anchor on.  Contexts of different buckets share nothing.
    """
    n = len(left)
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left_paths, left_depths = _trie_paths(bucket, left)
    right_paths, right_depths = _trie_paths(bucket, right)
    symbols, lengths, rows = array("q"), array("q"), array("q")
    offsets = array("q")  # bytes from the anchor to where the suffix begins, negative before it; above 0: not looked at
    for i in range(n):
        to_left, to_right = left_depths[i], right_depths[i]
        if not to_right or to_right[-1] + (to_left[-1] if to_left else 0) < least:
            continue
        for k in range(len(to_left) - 1, -1, -1):
            symbols.append(-left_paths[i][k])
            lengths.append(to_left[k] - (to_left[k - 1] if k else 0))
            offsets.append(-to_left[k])
        at = 0
        for number, depth in zip(right_paths[i], to_right, strict=True):
            symbols.append(number)
            lengths.append(depth - at)
            offsets.append(at)
            at = depth
        symbols.append(0)  # made different below: nothing goes on behind a context
        lengths.append(0)
        offsets.append(least)
        rows.extend([i] * (len(to_left) + len(to_right) + 1))
    if not rows:
        return before, behind
    text, length, row, offset = (np.array(x, np.int64) for x in (symbols, lengths, rows, offsets))
    del left_paths, left_depths, right_paths, right_depths, symbols, lengths, rows, offsets
    ends = np.flatnonzero(text == 0)
    text[ends] = text.min() - 1 - np.arange(len(ends))
    order = lyndon_suffix_array(text)
    # Bytes that each suffix shares with the one behind it.
    shared = np.zeros(len(order) - 1, np.int64)
    pair = np.arange(len(order) - 1)
    a, b = order[:-1], order[1:]
    step = 0
    while len(pair):
        inside = np.maximum(a[pair], b[pair]) + step < len(text)
        pair = pair[inside]
        same = text[a[pair] + step] == text[b[pair] + step]
        pair = pair[same]
        shared[pair] += length[a[pair] + step]
        step += 1
    longest = np.maximum(np.concatenate(([0], shared)), np.concatenate((shared, [0])))
    hit = (longest >= least) & (offset[order] <= 0)
    which = row[order[hit]]
    np.maximum.at(before, which, -offset[order[hit]])
    np.maximum.at(behind, which, offset[order[hit]] + longest[hit])
    return before, behind


def _shared_intervals(least: int):
    """Maps sorted context rows (gram, doc, anchor, first, data) of whole grams to intervals (doc, lo, hi)."""
    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        grams = np.array([r[0] for r in rows], np.int64)
        bucket = np.cumsum(np.concatenate(([0], (grams[1:] != grams[:-1]).astype(np.int64))))
        cuts = [r[2] - r[3] for r in rows]
        left = [r[4][:c][::-1] for r, c in zip(rows, cuts, strict=True)]
        right = [r[4][c:] for r, c in zip(rows, cuts, strict=True)]
        before, behind = covered_parts(bucket, left, right, least)
        hit = np.flatnonzero(behind)
        if not len(hit):
            return None
        anchor = np.array([r[2] for r in rows], np.int64)[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in hit.tolist()], pa.binary()),
             pa.array((anchor - before[hit]).astype(np.int32)), pa.array((anchor + behind[hit]).astype(np.int32))],
            names=["doc", "lo", "hi"])

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "anchor", "first", "data")), strict=True):
                if len(held) >= BATCH_CONTEXTS and row[0] != held[-1][0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := solve(held)) is not None:
            yield out

    return intervals


def _with_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted contexts of each text, with their bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            out: list[tuple] = []
            for doc, text, wanted in zip(*(batch.column(c).slice(at, 500).to_pylist() for c in ("doc", "text", "wanted")), strict=True):
                data = text.encode()
                out += [(w["gram"], w["hot"], doc, w["anchor"], w["first"], data[w["first"]:w["to"]]) for w in wanted]
            if out:
                gram, hot, doc, anchor, first, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram, pa.int64()), pa.array(hot, pa.bool_()), pa.array(doc, pa.binary()),
                     pa.array(anchor, pa.int32()), pa.array(first, pa.int32()), pa.array(data, pa.binary())],
                    names=["gram", "hot", "doc", "anchor", "first", "data"])


def _hot_intervals(contexts: DataFrame, least: int) -> DataFrame:
    """As the suffix arrays, for grams of too many contexts: each string by a 128-bit hash."""
    strings = contexts.select(
        "gram", "doc", "first", F.explode(F.sequence(F.lit(0), F.length("data") - least)).alias("at"), "data"
    ).select("doc", "first", "at", F.unhex(F.md5(F.expr(f"substring(data, at + 1, {least})"))).alias("key"))
    twice = strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return strings.join(twice, "key").groupBy("doc", "first").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(
        "doc", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + least).alias("hi"))


def repeated_intervals(docs: DataFrame, least: int = LEAST, most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(doc, lo, hi): intervals whose union are the covered bytes; (doc, text): the texts that have any.

    ``docs`` holds the texts as ``_text``, none null.
    """
    marks = materialise(marked_contexts(docs, least), "suffix-contexts")
    to = (F.col("last") + least).alias("to")
    hot = marks.where("wanted").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(f"n > {int(most_contexts)}")
    hot = materialise(hot.select("gram", F.lit(True).alias("hot")), "suffix-hot")
    wanted = marks.where("wanted").join(hot, "gram", "left").select(
        "doc", F.struct("gram", F.coalesce("hot", F.lit(False)).alias("hot"), "anchor", "first", to).alias("wanted"),
        F.lit(None).cast("struct<lo:int,hi:int>").alias("covered"))
    covered = marks.where("covered").select(
        "doc", F.lit(None).cast(wanted.schema["wanted"].dataType).alias("wanted"),
        F.struct(F.col("first").alias("lo"), to.alias("hi")).alias("covered"))
    # Copies of a text give the same marks: sets, aggregated before the shuffle, hold a text's anchors once.
    by_doc = wanted.unionByName(covered).groupBy("doc").agg(
        F.collect_set("wanted").alias("wanted"), F.collect_set("covered").alias("covered"))
    texts = docs.select(F.unhex(F.md5("_text")).alias("doc"), F.col("_text").alias("text")).groupBy("doc").agg(
        F.first("text").alias("text"))
    texts = materialise(texts.join(by_doc, "doc"), "suffix-texts")
    contexts = texts.where("size(wanted) > 0").select("doc", "text", "wanted").mapInArrow(
        _with_contexts, "gram long, hot boolean, doc binary, anchor int, first int, data binary")
    shared = contexts.where("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _shared_intervals(least), "doc binary, lo int, hi int")
    covered = texts.select("doc", F.explode("covered").alias("c")).select("doc", "c.lo", "c.hi")
    found = covered.unionByName(shared).unionByName(_hot_intervals(contexts.where("hot"), least))
    return found, texts.select("doc", "text")


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals, in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "parts")), strict=True):
            spans = merged([(p["lo"], p["hi"]) for p in parts])
            data, digest, at = text.encode(), hashlib.sha256(), 0
            for lo, hi in spans:
                digest.update(data[at:lo])
                at = hi
            digest.update(data[at:])
            out.append((doc, sum(hi - lo for lo, hi in spans), len(spans), digest.hexdigest(),
                        [{"lo": lo, "hi": hi} for lo, hi in spans]))
        if out:
            doc, removed, n, sha, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.binary()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                names=["doc", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, text_col: str = "text", least: int = LEAST, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``docs`` with ``_repeats``: struct (n_bytes, n_removed, n_spans, kept_sha256, spans), in UTF-8 bytes.

    ``spans``: the removed runs [lo, hi), in order.  A null text counts as
    empty; texts shorter than ``least`` bytes lose nothing; all rows and
    columns stay, whatever their names (repeated rows are copies of each other,
    so they are removed whole if long enough); an empty table gives no rows.
    ``docs`` is read several times: pass a table, not a long computation.
    ``least`` is over twice the 32 bytes of a gram and at most 65,000.
    """
    if not 2 * GRAM < least <= 65_000:
        raise ValueError(f"least must be from {2 * GRAM + 1} to 65000, not {least}")
    prepare(docs.sparkSession)
    own = docs.columns
    text = text_or_empty(F.col(f"`{text_col}`"))
    found, texts = repeated_intervals(docs.select(text.alias("_text")).where(F.octet_length("_text") >= least), least, most_contexts)
    parts = found.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    cut = texts.join(parts, "doc").mapInArrow(
        _cut, "doc binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"), F.unhex(F.md5(text)).alias("_doc"),
        F.octet_length(text).cast("long").alias("_n"), F.sha2(text, 256).alias("_sha"))
    cut = cut.select(F.col("doc").alias("_doc"), F.struct("n_removed", "n_spans", "kept_sha256", "spans").alias("_cut"))
    return packed.join(cut, "_doc", "left").select(
        *[F.col("_own").getField(c).alias(c) for c in own],
        F.struct(
            F.col("_n").alias("n_bytes"), F.coalesce("_cut.n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("_cut.n_spans", F.lit(0).cast("long")).alias("n_spans"),
            F.coalesce("_cut.kept_sha256", "_sha").alias("kept_sha256"),
            F.coalesce("_cut.spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")).alias("spans")).alias("_repeats"))


@query("op11_suffix_array_dedup")
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 200 bytes cover which also start elsewhere."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "_repeats.n_bytes", "_repeats.n_removed", "_repeats.n_spans", "_repeats.kept_sha256")
