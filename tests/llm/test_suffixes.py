from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from dropledger.llm import suffixes as S


def brute(texts, least):
    """Spans by counting every string of ``least`` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + least] for d in data for i in range(len(d) - least + 1))
    spans = [S.merged([(i, i + least) for i in range(len(d) - least + 1) if seen[d[i:i + least]] > 1]) for d in data]
    out = []
    for d, parts in zip(data, spans, strict=True):
        kept, at = b"", 0
        for lo, hi in parts:
            kept, at = kept + d[at:lo], hi
        out.append((len(d), sum(hi - lo for lo, hi in parts), len(parts), hashlib.sha256(kept + d[at:]).hexdigest(), parts))
    return out


def corpus(seed, letters, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(0, 500))) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(base)
            a = rng.randint(0, len(part))
            text += part[a:rng.randint(a, len(part))] + "".join(rng.choices("xyé ", k=rng.choice([0, 0, 30])))
        texts.append(text)
    return texts


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 5, 30])
        s = [rng.randrange(k) - 2 for _ in range(n)]
        if rng.random() < 0.3:
            s = (s[:5] * 6)[:30]
        assert S.lyndon_suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    for long in ([1, 2, 1, 3] * 150, [2, 1] * 300 + [3], list(range(300)) * 2):
        assert S.lyndon_suffix_array(np.array(long)).tolist() == sorted(range(len(long)), key=lambda i: long[i:])


def test_anchors_are_those_of_the_definition(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(900) + b"a" * 300, np.uint8)
    keys = S._gram_hashes(data) >> np.uint64(16)
    window = 100 - S.GRAM + 1
    want = [i + int(np.argmin(keys[i:i + window])) for i in range(len(data) - 99)]
    assert S.anchors(data, 100).tolist() == want
    monkeypatch.setattr(S, "WINDOW_PLACES", 256)
    assert S.anchors(data, 100).tolist() == want


@pytest.mark.parametrize(("letters", "least", "most"), [("ab", 70, 10_000), ("abcdefgh ", 100, 10_000), ("abcdefgh ", 100, 2), ("a", 200, 3)])
def test_removed_bytes_equal_brute_force(spark, letters, least, most):
    texts = corpus(len(letters) + most, letters)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: r[1] for r in S.remove_repeats(docs, least=least, most_contexts=most).select("doc_id", "_repeats").collect()}
    want = brute(texts, least)
    assert any(w[1] for w in want)
    for i, w in enumerate(want):
        g = got[i]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256, [tuple(s) for s in g.spans]) == w


def test_groups_cut_by_range_borders(spark):
    """Few rows a range: hot grams and contexts go on over many ranges."""
    line = "".join(random.Random(9).choices("abcdefgh ", k=260))
    texts = [f"{i:05d} " * (i % 3) + line + f" {i * i}" for i in range(120)] + [line] * 60 + [line[:199], line[:200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r[0]: r[1] for r in S.remove_repeats(docs).select("doc_id", "_repeats").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for i, w in enumerate(brute(texts, 200)):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[1:4]


def test_strange_rows(spark):
    long = "".join(random.Random(4).choices("abcdefghij ", k=90_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "q" + long[70_000:70_250]), (5, "é" * 100), (6, "é" * 99 + "e"), (7, "a" * 900)]
    names = "doc_id long, text string, gram string, doc string, _own string, _doc string, hot string, lo string"
    docs = spark.createDataFrame([(*r, *["mine"] * 6) for r in rows], names)
    out = S.remove_repeats(docs)
    assert out.columns == [*docs.columns, "_repeats"]
    got = sorted((str(r.doc_id), r.text or "", tuple(r._repeats)[:4], tuple(r)[2:8]) for r in out.collect())
    want = brute([r[1] for r in rows], 200)
    assert got == sorted((str(r[0]), r[1] or "", w[:4], ("mine",) * 6) for r, w in zip(rows, want, strict=True))
    assert S.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="least"):
        S.remove_repeats(docs, least=64)
