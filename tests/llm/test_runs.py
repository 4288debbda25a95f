from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dropledger.llm import runs as R


def brute(words):
    """(start, length, period) by comparing the words at every distance."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, k, q) for (s, k), q in best.items())


def row_of(i, text):
    words = (text or "").encode().split()
    runs = brute(words)
    gone = {w for s, k, q in runs for w in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for n, w in enumerate(words) if n not in gone)).hexdigest())


def with_tail(i, text):
    h, words = zlib.crc32(str(i).encode()), (text or "").encode().split()
    if h % 10 or not words or i is None:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n)).decode()


def some_texts(seed, n, longest=300):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.choice([1, 2, 3, 5, 40])
        words = [rng.choice(["ab", "c", "déf", "g,", "h"][:k]) if k < 40 else f"w{rng.randrange(k)}" for _ in range(rng.randint(0, longest))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 2))
            words = [words[j if j < a else a + (j - a) % p] for j in range(len(words))]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "other"
        yield rng.choice([" ", "\n", " \t\x0b "]).join(words)


@pytest.mark.parametrize("long", [10**9, 20])
def test_runs_equal_brute_force(spark, monkeypatch, long):
    """Once solved where the text was read, once by rows of tiles dealt to all tasks."""
    monkeypatch.setattr(R, "ROW_WORDS", 60)
    texts = list(some_texts(7, 150))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: sorted(tuple(x) for x in r.runs) for r in R.find_runs(docs, long=long).collect()}
    assert got == {i: brute(t.encode().split()) for i, t in enumerate(texts)}
    assert any(len(v) > 1 for v in got.values())


def test_every_tile_of_a_run_is_active():
    for text in some_texts(11, 300):
        ids = R.word_ids(text)
        before = R.previous_places(ids)
        if before is None:
            assert brute(ids.tolist()) == []
            continue
        for low, high, step in R.octaves(len(ids)):
            active = set(R.active_tiles(before, len(ids), high, step).tolist())
            for start, length, q in brute(ids.tolist()):
                if low <= q <= high:
                    tiles = [m for m in range(0, len(ids), step) if start <= m < start + length - q]
                    assert tiles and active >= set(tiles)


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        assert R.z_function(s) == [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(len(s))]


def test_contract_rows(spark, tmp_dir):
    texts = list(some_texts(3, 120, 80)) + [None, "", " \n", "same " * 5000, "one two " * 6, "one two " * 5 + "one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = sorted(map(tuple, R.op12_periodic_runs(spark, tmp_dir).collect()), key=str)
    assert got == sorted((row_of(i, with_tail(i, t)) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_strange_tables(spark):
    names = "doc_id long, text string, runs string, n string, _row string, period string, words string, _text string"
    docs = spark.createDataFrame([(1, "a b " * 7, *["x"] * 6), (None, None, *[None] * 6)], names)
    got = R.find_runs(docs).select("doc_id", "n", F.size("runs")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 14, 1), (None, 0, 0)]
    assert R.find_runs(docs.limit(0)).collect() == []
    assert R.find_runs(docs.select(F.lit("k").alias("doc_id"), "text")).where("n = 14").first().doc_id == "k"
    assert np.array_equal(R.word_ids("b a\x1cb b"), [0, 1, 0])
