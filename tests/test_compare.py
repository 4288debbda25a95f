"""Two months compared: pairing against a record-by-record version."""

import random
from collections import Counter

import pytest

from dropledger.operators.compare import compare_months


def brute(a, b):
    out = Counter()
    for key in {r[0] for r in a + b}:
        left, right = Counter(r[1:] for r in a if r[0] == key), Counter(r[1:] for r in b if r[0] == key)
        both = left & right
        for v, n in both.items():
            out[key, "same", v, v] += n
        rank = lambda v: tuple((x is not None, x or 0) for x in v)
        xs, ys = (sorted((c - both).elements(), key=rank) for c in (left, right))
        for k in range(max(len(xs), len(ys))):
            x, y = xs[k] if k < len(xs) else None, ys[k] if k < len(ys) else None
            out[key, "added" if x is None else "removed" if y is None else "changed", x, y] += 1
    return dict(out)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    a, b = ([(rng.choice([None, 1, 2, 2, 2, 3, k]), rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", "y"])) for _ in range(rng.randint(0, 60))]
            for k in (10, 11))
    frames = [spark.createDataFrame(rows, "k int, v int, w string") for rows in (a, b)]
    got = {(r.k, r.change, r.before and tuple(r.before), r.after and tuple(r.after)): r.n
           for r in compare_months(*frames, ["k"], ["v", "w"]).collect()}
    assert got == brute(a, b)


def test_empty_months(spark):
    some = spark.createDataFrame([(1, 5), (1, 5)], "k int, v int")
    assert [tuple(r)[:2] + (r.n,) for r in compare_months(some, some.limit(0), ["k"], ["v"]).collect()] == [(1, "removed", 2)]
    assert compare_months(some.limit(0), some.limit(0), ["k"], ["v"]).collect() == []


def test_a_hot_key_makes_no_product(spark):
    """One key for all records: as many lines as different records, not their product."""
    frames = [spark.range(3000).selectExpr("1 as k", f"id * 2 + {i} as v") for i in (0, 1)]
    assert {r.change: r["count"] for r in compare_months(*frames, ["k"], ["v"]).groupBy("change").count().collect()} == {"changed": 3000}
