"""Hot keys: one key holds a third of the rows; results equal the straightforward forms."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dropledger.operators.changelog import fold_state
from dropledger.operators.sequence import with_previous, with_session_id


def _events(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 1 if i % 3 == 0 else rnd.randrange(2, 40)          # user 1: a third of all rows
        ts = base + dt.timedelta(seconds=rnd.randrange(0, 20 * 86400))
        rows.append((i, user, ts, rnd.random()))
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double")


def _plain(e, gap):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = e.withColumn("prev", F.lag("ts").over(w))
    start = F.when(F.col("prev").isNull() | (F.timestamp_diff("SECOND", F.col("prev"), F.col("ts")) > gap), 1).otherwise(0)
    plain = plain.withColumn("s", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return {r["event_id"]: (r["prev"], r["s"]) for r in plain.collect()}


def _ranged(e, gap):
    s = with_session_id(with_previous(e, "user_id", ["ts", "event_id"], "prev"), "user_id", ["ts", "event_id"], gap)
    return {r["event_id"]: (r["prev"], r["session_id"]) for r in s.collect()}


@pytest.fixture(params=[4, 37])
def ranges(spark, request):
    """Few ranges, or so many that most hold part of one key only."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranged_sequence_matches_plain_window(spark, ranges):
    e = _events(spark)
    got = _ranged(e, 2 * 3600)
    assert got == _plain(e, 2 * 3600)
    assert max(s for _, s in got.values()) > 10


def test_one_hour_of_one_key_is_spread_over_tasks(spark, ranges):
    """90 % of the rows in one hour of one key, many at the same second, null keys among the rest."""
    rnd, base = random.Random(8), dt.datetime(2024, 5, 1)
    rows = [(i, 7, base + dt.timedelta(seconds=rnd.randrange(3600)), 0.0) for i in range(2700)]
    rows += [(3000 + i, rnd.choice([None, 3, 7, 9]), base + dt.timedelta(seconds=rnd.randrange(200_000)), 0.0) for i in range(300)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").repartition(5)
    for gap in (1, 600):
        assert _ranged(e, gap) == _plain(e, gap)
    sizes = [r[0] for r in e.repartitionByRange("user_id", "ts", "event_id").groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert max(sizes) < 3 * len(rows) / ranges
    assert _ranged(e.limit(0), 5) == {}


def test_events_are_shuffled_once(spark, tmp_dir):
    from tests.test_plans import plan
    e = _events(spark, 200)
    e.write.parquet(f"{tmp_dir}/events")
    out = with_previous(spark.read.parquet(f"{tmp_dir}/events"), "user_id", ["ts", "event_id"], "prev")
    text = plan(out, "simple")  # the one shuffle was written; what is left reads it and a broadcast row for each range
    assert "Exchange hashpartitioning(user_id" not in text and "rangepartitioning" not in text


def test_fold_with_hot_key_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(("hot" if i % 3 == 0 else f"k{rnd.randrange(50)}"), rnd.randrange(10 ** 6), i, f"v{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, seq long, id long, v string").repartition(7)
    got = {r["key"]: (r["v"], r["n"]) for r in fold_state(df, ["key"], ["seq", "id"], last=["v"], versions="n").collect()}
    pdf = pd.DataFrame(rows, columns=["key", "seq", "id", "v"]).sort_values(["seq", "id"])
    want = {k: (g["v"].iloc[-1], len(g)) for k, g in pdf.groupby("key")}
    assert got == want
