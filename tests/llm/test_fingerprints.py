from __future__ import annotations

import hashlib
import random

import numpy as np

from dropledger.llm import fingerprints as P


def brute_signature(text):
    """The definition, byte by byte."""
    def value(i):
        window = [text[j] if j >= 0 else 0 for j in range(i, i - P.WINDOW, -1)]
        total = sum(b * (1 + P.WINDOW - k) for k, b in enumerate(window))
        mixed = 0
        for k, b in enumerate(window):
            mixed ^= (b << (5 * k)) & 0xFFFFFFFF
        return ((total + mixed) & 0xFFFFFFFF) + 1

    values = [value(i) for i in range(len(text))]

    def chunks(size):
        ends = [i + 1 for i, v in enumerate(values) if v % size == 0]
        if text and (not ends or ends[-1] != len(text)):
            ends.append(len(text))
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    size = P.SMALLEST
    while sum(v % size == 0 for v in values) >= P.MOST_CHUNKS:
        size *= 2

    def symbols(size):
        return "".join(P.SYMBOLS[__import__("zlib").crc32(c) & 4095] for c in chunks(size))
    return f"{size}:{symbols(size)}:{symbols(2 * size)}"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = [b"", b"a", b"abc", b"\0\0\0", b"a" * 5000, "é ñ".encode() * 50, *(prose(rng, n).encode() for n in (5, 60, 700))]
    assert P.fingerprints(texts) == [brute_signature(t) for t in texts]
    assert P.fingerprints([b""]) == ["3::"]


def test_likeness():
    rng = random.Random(2)
    for _ in range(20):
        a, b = ([rng.choice("ABCD") + "x" for _ in range(rng.randrange(1, 30))] for _ in range(2))
        want = 1 - edit_distance(a, b) / (len(a) + len(b))
        assert a == b or abs(P.likeness(f"3:{''.join(a)}:", f"3:{''.join(b)}:") - want) < 1e-12
        assert a == b or abs(P.likeness(f"6:{''.join(a)}:", f"3::{''.join(b)}") - want) < 1e-12
    assert P.likeness("3::", "3::") == 1 and P.likeness("3:AA:BB", "12:AA:BB") == 0
    text = prose(rng, 500)
    one, two, other = P.fingerprints([text.encode(), (text[:1000] + "edit" + text[1010:]).encode(), prose(rng, 500).encode()])
    assert P.likeness(one, two) > 0.9 and P.likeness(one, other) < 0.2


def check(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
        got = P.compare_neighbours(docs.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        own, changed, following = P.fingerprints([t.encode(), edited.encode(), after.encode()])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
                     P.likeness(own, changed), P.likeness(own, following)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 3, prose(rng, rng.randrange(0, 120))) for i in range(90)]
    rows += [(6, "é" * 41), (6, None), (None, "null id"), (300, ""), (10 ** 12, "\U0001f600 far away")] + [(9, "same")] * 2
    rng.shuffle(rows)
    for parts in (1, 7):
        check(spark, rows, parts)
    check(spark, [(1, "only one row of text")], 4)


def test_empty_table(spark):
    assert P.compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_halves_are_recognised():
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (40, 200, 1000, 4000)]
    for t, u in zip(texts, texts[1:], strict=False):
        half = len(t) // 2
        a, b, c = P.fingerprints([t.encode(), (t[:len(t) - half] + u[:half]).encode(), u.encode()])
        assert P.likeness(a, b) > 0.25 > P.likeness(a, c)
    assert np.mean([len(P.fingerprints([t.encode()])[0].split(":")[1]) // 2 for t in texts]) > 20
