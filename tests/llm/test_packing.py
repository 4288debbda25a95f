from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from dropledger.llm import packing as K

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "a \nb", "x\ty z", "don't we'll they're", "<|endoftext|> hi",
         "hi <|endoftext|>", "naïve ñé b", "123 456abc,,, !!?", "a\r\nb", "\x1cq a\x1cb!\x1c", "日本語 テスト\n次", "é x",
         "a​b c﻿", "😀 😀x\n😀", "a" * 3000 + " " + "b" * 10, "plain words\nin two lines", "word " * 1500 + "end"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [K.END_ID]


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    for limit in (64, 1 << 20):
        monkeypatch.setattr(K, "LAYOUT_BYTES", limit)
        got = []
        for flat, ends in K.Encoder(JSON, RANKS).encode(pa.array(TEXTS * 2)):
            got += [x.tolist() for x in np.split(flat, ends)[:-1]]
        assert got == [ids_of(tokenizer, t) for t in TEXTS * 2]


def test_cut():
    assert K.cut(5, 4) == [(0, 1), (1, 4)] and K.cut(8, 4) == [(0, 4), (4, 4)] and K.cut(3, 4) == [(0, 3)]


def brute_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100, 500)
    bins, offsets, n = K.best_fit_decreasing(lengths, 100)
    fill = np.bincount(bins, weights=lengths)
    assert sorted(100 - fill) == brute_best_fit(lengths.tolist(), 100) and n == len(fill)
    for b in range(n):
        order = np.argsort(offsets[bins == b])
        sizes = lengths[bins == b][order]
        assert offsets[bins == b][order].tolist() == [0, *np.cumsum(sizes)[:-1].tolist()]
    bound = K.lower_bound(lengths, 100)
    assert lengths.sum() / 100 <= bound <= n
    assert K.lower_bound(np.array([51] * 7 + [49]), 100) == 7  # better than the sum's 5


def check(spark, tokenizer, rows, packed):
    got = packed.collect()
    want = []
    for d, t in rows:
        ids = np.array(ids_of(tokenizer, t), "<u4")
        want += [(d, p, s, n, zlib.crc32(ids[s:s + n].tobytes())) for p, (s, n) in enumerate(K.cut(len(ids)))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= K.CAPACITY
    return len(sequences)


def test_documents(spark, tokenizer):
    rows = [(i if i % 7 else None, t) for i, t in enumerate([None, *TEXTS])] + [(3, "copy")] * 3
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, length int")
    check(spark, tokenizer, rows, K.pack_documents(docs))
    assert K.pack_documents(docs.limit(0)).count() == 0


def test_exchange_between_partitions_saves_sequences(spark, monkeypatch):
    monkeypatch.setattr(K, "PIECES_PER_TASK", 60)
    rng = np.random.default_rng(5)
    lengths = rng.integers(200, 500, 900)
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "_row long, length long")
    got = K.pack_pieces(pieces).toPandas().merge(pieces.toPandas(), on="_row")
    assert len(got) == 900 and (got.groupby("sequence_id").length.sum() <= K.CAPACITY).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    alone = K.pack_pieces(pieces, rounds=0).select("sequence_id").distinct().count()
    assert got["round"].max() >= 1 and got.sequence_id.nunique() < alone
    assert got.sequence_id.nunique() >= K.lower_bound(lengths)
