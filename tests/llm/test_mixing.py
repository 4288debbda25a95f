from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pytest

from dropledger.llm import mixing as M


@pytest.fixture(autouse=True)
def short_stretches(monkeypatch):
    """Cuts every 37 slots, so that stretches meet in all tests."""
    monkeypatch.setattr(M.block_schedule, "__defaults__", (37, M.STRETCHES))


def test_order_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"s{i % 5}", "t") for i in range(200)], "doc_id long, source string, j string")
    mixed = {r.doc_id: r["_mix"].position for r in M.mix_sources(df).collect()}
    laid = [r.doc_id for r in M.mixed_order(df).collect()]
    assert [mixed[i] for i in laid] == sorted(mixed.values()) and M.mixed_order(df).columns == df.columns
    assert M.mixed_order(df.limit(0)).count() == 0 and M.mix_sources(df.limit(0)).count() == 0


def ideal_flow(blocks, weights, t):
    """Blocks that each source has received by ``t`` if it is served by weight until it ends."""
    low, high = Fraction(0), max(Fraction(n) / w for n, w in zip(blocks, weights, strict=True))
    for v in sorted({Fraction(n) / w for n, w in zip(blocks, weights, strict=True)}):
        if sum(min(n, w * v) for n, w in zip(blocks, weights, strict=True)) <= t:
            low = v
        else:
            high = v
            break
    at_low = sum(min(n, w * low) for n, w in zip(blocks, weights, strict=True))
    active = sum(w for n, w in zip(blocks, weights, strict=True) if w * low < n)
    v = min(high, low + Fraction(t - at_low) / active) if active else low
    return [min(Fraction(n), w * v) for n, w in zip(blocks, weights, strict=True)]


def deviations(spark, sizes, weights, block_rows=1):
    """Blocks received less the target by target weights, at every slot."""
    df = spark.createDataFrame([(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)],
                               "doc_id long, source string")
    got = M.mix_sources(df, weights=weights, block_rows=block_rows).select("source", "doc_id", "_mix.*").collect()
    assert sorted(r.position for r in got) == list(range(sum(sizes.values())))
    slots = {r.slot: r.source for r in got}
    names = list(sizes)
    blocks = [-(-n // block_rows) for n in sizes.values()]
    assert sorted(slots) == list(range(sum(blocks))) and all(r.release <= r.slot < r.deadline for r in got)
    exact = [Fraction(weights[s]) for s in names]
    given, worst = Counter(), 0
    for t in range(sum(blocks)):
        given[slots[t]] += 1
        flow = ideal_flow(blocks, exact, t + 1)
        worst = max([worst, *(abs(given[s] - x) for s, x in zip(names, flow, strict=True))])
    return worst


def test_deviation_from_target_weights_with_few_sources(spark):
    sizes = {"a": 700, "b": 333, "c": 500, "d": 2}
    assert deviations(spark, sizes, {"a": 5.03, "b": 3, "c": 1.7, "d": 0.001}) < 1.001
    assert deviations(spark, {"a": 7, "b": 90}, {"a": 0.5, "b": 0.5}, block_rows=4) < 1.001


def test_deviation_from_target_weights_with_more_than_200_sources(spark):
    sizes = {f"s{i:03}": 3 for i in range(230)} | {"big": 600}
    assert deviations(spark, sizes, dict.fromkeys(sizes, 1.0) | {"big": 230.0}) < 1.001


def test_one_stretch_or_many_meet_all_windows(spark):
    """The counts at the cuts differ from those of one stretch now and then, the windows never."""
    df = spark.createDataFrame([(i, "abcde"[i % 11 % 5]) for i in range(1500)], "doc_id long, source string")
    table = M.materialise(M.source_weights(df, weights={"a": 5.1, "b": 3, "c": 1.7, "d": 0.3, "e": 0.01}, block_rows=1), "test-weights")
    windows = None
    for per, most in ((10_000, 10), (600, 10), (50, 4096), (1, 25), (7, 4096)):
        got = M.block_schedule(table, 1, per, most).collect()
        assert sorted(r.slot for r in got) == list(range(1500)) and all(r.release <= r.slot < r.deadline for r in got)
        assert all(r.first_row == r.slot for r in got)
        assert windows in (None, windows := sorted((r.idx, r.block, r.release, r.deadline) for r in got))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 7, "b": 7}, {"a": 3, "b": 90}, {"s" * n: n for n in range(1, 15)}])
def test_small_tables(spark, sizes):
    assert deviations(spark, sizes, dict.fromkeys(sizes, 1.0) | {"a": 2.5}, block_rows=3) < 1.001


def test_names_that_the_operator_uses(spark):
    names = ("own", "key", "h", "bucket", "_bucket", "_rank", "r", "at", "start", "blocks", "idx", "weight", "_mix_slot", "a.b")
    rows = [(i, f"s{i % 3}", *[f"{c} of {i}" for c in names]) for i in range(60)]
    rows += [(None, None, *["null"] * len(names))] * 3
    df = spark.createDataFrame(rows, ["doc_id", "source", *names])
    for out in (M.mix_sources(df).drop("_mix"), M.mixed_order(df)):
        assert out.columns == df.columns
        assert Counter(map(tuple, out.collect())) == Counter(rows)


def test_repeated_ids_are_dealt_by_their_rows(spark):
    df = spark.createDataFrame([(7 if i % 2 else None, "s", f"text {i}") for i in range(500)], "doc_id long, source string, text string")
    assert sorted(r.position for r in M.mix_sources(df).select("_mix.position").collect()) == list(range(500))


def test_source_without_weight_comes_last(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "doc_id long, source string")
    last = M.mix_sources(df, weights={"a": 2, "b": 1}, block_rows=1).orderBy("_mix.position").select("source").collect()[-19:]
    assert {r.source for r in last} == {"c"}
