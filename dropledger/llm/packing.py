"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Tokens: a document is its token ids and an end id; only one longer than a
sequence is cut, into whole sequences with the (shorter) rest first.  Whole
pieces are sequences of their own; the others are packed.

Pieces are dealt in turn, in the order of their lengths, to partitions of some
65,000, a bounded task each; so all partitions have nearly the same lengths,
and none is short of small or large pieces.  A task packs by best-fit
decreasing and computes a lower bound of its bins: the greatest over
dual-feasible functions, which map lengths so that no full sequence maps to
more than one.  Bins equal to the bound are proven fewest.  Partitions with a
gap give the pieces of their loosely filled bins to a pool, which is dealt
anew to mixed partitions and packed again by the same rule, as long as that
saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, number_within, prepare, read_table, text_or_empty

CAPACITY = 1024
END_ID = 2
#: Pieces that one packing task takes, about.
PIECES_PER_TASK = 65_536
#: Rows that one numbering task takes, about.
ROWS_PER_BUCKET = 10_000
#: Exchanges at most, and the fill below which a bin takes part.
ROUNDS = 4
LOOSE = 0.97
#: Documents encoded together in a task, and those whose ids are laid out at once, by bytes of text.
ENCODE_BYTES = 4 << 20
LAYOUT_BYTES = 2 << 20

#: White space other than a single blank or line end between words, and the end mark: such texts are encoded whole.
IRREGULAR = (
    r"^[ \n]|[ \n]$|[ \n][ \n]|<\|endoftext\|>"
    r"|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


# ---------------------------------------------------------------- token ids

class Encoder:
    """Ids of many texts at once.

    The vocabulary's words begin with the blank before them, so a text is the
    sequence of its words, and the ids of a word don't depend on its
    neighbours.  Each different word of a batch is encoded once.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path, self.tokenizer = json_path, None
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def whole(self, text: str) -> list[int]:
        """Ids of a text by the tokenizer itself, which is loaded when the first such text comes."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.json_path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of consecutive texts: flat ids with END_ID behind each text, and where each text ends."""
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        # "\n" before a text is a token of its own; it makes room for the end id.
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        words = pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")
        ids = np.asarray(self.words.encode_ordinary("".join(words.to_pylist())), np.uint32)
        # Words end where the widths of their tokens add up to theirs.
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(pc.binary_length(words).to_numpy()), "left") + 1
        starts = np.concatenate(([0], stops[:-1])).astype(np.int64)
        counts = (stops - starts).astype(np.int64)
        del words, coded
        offsets = lists.offsets.to_numpy()
        sizes = pc.binary_length(texts).to_numpy()
        at, next_plain = 0, 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), LAYOUT_BYTES)) + at)
            flags = odd[at:upto]
            n_plain = int((~flags).sum())
            own = codes[offsets[next_plain]:offsets[next_plain + n_plain]]
            n = counts[own]
            flat = ids[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            word_ends = np.concatenate(([0], np.cumsum(n)))
            ends = word_ends[offsets[next_plain + 1:next_plain + n_plain + 1] - offsets[next_plain]]
            flat[:-1] = flat[1:]
            flat[ends - 1] = END_ID
            if flags.any():
                parts, k = [], 0
                begins = np.concatenate(([0], ends[:-1]))
                for i, strange in enumerate(flags):
                    if strange:
                        parts.append(np.asarray([*self.whole(texts[at + i].as_py()), END_ID], np.uint32))
                    else:
                        parts.append(flat[begins[k]:ends[k]])
                        k += 1
                flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
            yield flat, ends
            at, next_plain = upto, next_plain + n_plain


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` tokens."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with some ENCODE_BYTES of text each (at least a row)."""
    sizes = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // ENCODE_BYTES
    for at in np.unique(part, return_index=True)[1].tolist():
        yield batch.slice(at, int((part == part[at]).sum()))


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """(_row, id_col, piece, start, length, ids_crc32) of every piece; ``_row`` numbers the pieces uniquely.

    With ``order``, a string for each document, the pieces have it as ``_order``.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(F.col(f"`{text_col}`")).alias("_text"),
                         *([] if order is None else [order.alias("_order")]))
    id_type = narrow.schema["_id"].dataType.simpleString()
    more, more_type = ([], "") if order is None else (["_order"], ", _order string")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, row = None, TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in _slices(whole)):
            encoder = encoder or Encoder(json_path, ranks_path)
            texts = batch.column("_text")
            texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
            doc, out = 0, []
            for flat, ends in encoder.encode(texts):
                data = memoryview(flat.astype("<u4").tobytes())
                begin = 0
                for end in ends.tolist():
                    for number, (start, length) in enumerate(cut(end - begin, capacity)):
                        a = 4 * (begin + start)
                        out.append((doc, number, start, length, zlib.crc32(data[a:a + 4 * length])))
                    begin, doc = end, doc + 1
            docs_, number, start, length, crc = (np.array(c, np.int64) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(docs_))), batch.column("_id").take(pa.array(docs_)),
                 pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc),
                 *(batch.column(c).take(pa.array(docs_)) for c in more)],
                names=["_row", "_id", "piece", "start", "length", "ids_crc32", *more])
            row += len(docs_)

    return narrow.mapInArrow(
        pieces, f"_row long, _id {id_type}, piece int, start long, length long, ids_crc32 long{more_type}"
    ).withColumnRenamed("_id", id_col)


# ---------------------------------------------------------------- packing

def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins.

    Bins are kept by their free room; a bit mask of the rooms in use finds the
    tightest that holds a piece.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            into = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, into, n = capacity, n, n + 1
        bins[i], offsets[i] = into, capacity - room
        if left := room - size:
            rooms[left].append(into)
            mask |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins by dual-feasible functions: thresholds, and rounding to multiples of 1 / k."""
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for small in range(1, capacity // 2 + 1):
        kept = int((count * x)[small:capacity - small + 1].sum()) + capacity * int(count[capacity - small + 1:].sum())
        best = max(best, -(-kept // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * x
        rounded = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((count * rounded).sum()) // (capacity * k)))
    return best


def _packed(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    part = part.sort_values("_row", ignore_index=True)
    lengths = part["length"].to_numpy()
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n)
    return part.assign(bin=bins, offset=offsets, loose=fill[bins] < LOOSE * capacity, bins=n, bound=lower_bound(lengths, capacity))


def _pack_round(items: DataFrame, n_items: int, number: int, capacity: int) -> DataFrame:
    """One best-fit-decreasing pass over ``items`` (_row, length), dealt in turn by length, or by ``_order`` if they have it."""
    parts = max(1, -(-n_items // PIECES_PER_TASK))
    schema = "_row long, length long, part long, bin long, offset long, loose boolean, bins long, bound long"
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # a row for each length
    starts = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).select(
        "length", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("start"))
    dealt = (
        number_within(items, ["length"], ["_row"], "place", 1 + n_items // ROWS_PER_BUCKET)
        .join(F.broadcast(starts), "length")
        .select("_row", "length", F.pmod(F.col("start") + F.col("place"), F.lit(parts)).cast("long").alias("part"))
    )
    if "_order" in items.columns:
        dealt = items.repartitionByRange(parts, "_order").select("_row", "length", F.spark_partition_id().cast("long").alias("part"))
    packed = dealt.groupBy("part").applyInPandas(lambda part: _packed(part, capacity), schema)
    return materialise(packed.withColumn("round", F.lit(number)), f"pack-round-{number}")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """(_row, sequence_id, offset, round, part_bins, part_bound) for pieces (_row, length).

    Pieces with ``_order`` are packed in runs of it, so that a sequence has
    pieces from one run (but for the few bins that are exchanged).
    """
    items = pieces.where(F.col("length") < capacity).select(*[c for c in ("_row", "length", "_order") if c in pieces.columns])
    packed = _pack_round(items, items.count(), 0, capacity)
    swaps = (F.col("bins") > F.col("bound")) & F.col("loose")
    for number in range(1, rounds + 1):
        parts_with_gap, n_pool, pool_bins = packed.agg(
            F.count_distinct(F.when(swaps, F.struct("round", "part"))),
            F.count(F.when(swaps, 1)),
            F.count_distinct(F.when(swaps, F.struct("round", "part", "bin")))).first()
        if parts_with_gap < 2:
            break
        again = _pack_round(packed.where(swaps).select("_row", "length"), n_pool, number, capacity)
        if again.select("part", "bins").distinct().agg(F.sum("bins")).first()[0] >= pool_bins:
            break
        packed = packed.where(~swaps).unionByName(again)
    # Whole pieces are numbered by their row (below 2^56), packed bins by round, partition and bin above that.
    sequence = F.expr("(round + 1) * 72057594037927936 + part * 16777216 + bin")
    whole = pieces.where(F.col("length") == capacity).select(
        "_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(None).cast("int").alias("round"), F.lit(None).cast("long").alias("part_bins"),
        F.lit(None).cast("long").alias("part_bound"))
    return packed.select(
        "_row", sequence.alias("sequence_id"), "offset", "round", F.col("bins").alias("part_bins"),
        F.col("bound").alias("part_bound")).unionByName(whole)


def pack_documents(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   order: Column | None = None) -> DataFrame:
    """A row for each piece of each document with its place in a sequence.

    With ``order``, a string column of ``docs``, documents are packed in runs
    of it and sequence ids follow the least ``order`` of their pieces.

    A null text counts as empty, and an empty document is its end id alone.
    Repeated rows and null ids stay, each with pieces of its own; other
    columns aren't read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    if json_path is None or ranks_path is None:
        import public_tokenizers

        json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = materialise(token_pieces(docs, json_path, ranks_path, id_col, text_col, capacity, order), "pack-pieces")
    packed = pieces.join(pack_pieces(pieces, capacity), "_row").drop("_row")
    return packed if order is None else _in_order(materialise(packed, "pack-placed"))


def _in_order(packed: DataFrame) -> DataFrame:
    """``sequence_id`` anew, rising with the least (_order, piece) of a sequence."""
    least = packed.groupBy("sequence_id").agg(F.min(F.struct("_order", "piece")).alias("least"))
    numbers = materialise(
        least.repartitionByRange("least").sortWithinPartitions("least")
        .select("sequence_id", F.monotonically_increasing_id().alias("_number")), "pack-numbers")
    return packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("_number")).drop("_number", "_order")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "part_bins", "part_bound")
