"""Streaming forms agree with their batch twins (Trigger.AvailableNow)."""

import os
import time
import zipfile

from pyspark.sql import functions as F

from dropledger.operators.sequence import with_previous
from dropledger.streaming import events as ev
from dropledger.streaming.landing import landing_diff, landing_state, landing_stream
from tests.conftest import SF_SMALL


def _events(spark, tmp_dir, parts=1):
    src = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    d = os.path.join(tmp_dir, "events")
    src.repartition(parts, "event_id").write.parquet(d)
    return src, d


def _run(spark, stream_df, tmp_dir, mode, name):
    out = []

    def collect(batch, bid):
        out.append((bid, [r.asDict() for r in batch.collect()]))

    q = (stream_df.writeStream.outputMode(mode).foreachBatch(collect)
         .option("checkpointLocation", os.path.join(tmp_dir, f"ckpt-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return out


def test_debounce_stream_matches_batch(spark, tmp_dir):
    src, d = _events(spark, tmp_dir)
    gap = 4 * 3600
    stream = spark.readStream.schema(src.schema).parquet(d)
    got = _run(spark, ev.debounce_stream(stream, "user_id", "ts", "value", gap, watermark="0 seconds"),
               tmp_dir, "append", "deb")
    streamed = {(r["user_id"], r["session_start"], r["session_end"], r["last_value"], r["n_events"])
                for _, b in got for r in b}
    batch = ev.debounce(src, "user_id", "ts", "value", gap, tiebreak="event_id")
    max_ts = src.agg(F.max("ts")).first()[0]
    closed = {tuple(r) for r in batch.filter(F.col("session_end") <= F.lit(max_ts))
              .select("user_id", "session_start", "session_end", "last_value", "n_events").collect()}
    assert streamed and streamed == closed


def test_latest_progress_stream_matches_batch(spark, tmp_dir):
    src, d = _events(spark, tmp_dir, parts=3)
    rec = lambda df: df.select(F.col("user_id").alias("target"), "ts", "event_id", F.col("event_type").alias("status"),
                               F.floor(F.col("value") * 10).cast("long").alias("bytes_done"),
                               F.lit(1000).cast("long").alias("bytes_total"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(d)
    cols = ["status", "bytes_done", "bytes_total"]
    got = _run(spark, ev.latest_progress(rec(stream), "target", F.struct("ts", "event_id"), cols), tmp_dir, "complete", "prog")
    assert len(got) >= 3
    last = {r["target"]: (r["status"], r["bytes_done"], r["percent"]) for r in got[-1][1]}
    batch = ev.latest_progress(rec(src), "target", F.struct("ts", "event_id"), cols)
    assert last == {r["target"]: (r["status"], r["bytes_done"], r["percent"]) for r in batch.collect()}


def test_throttle_clock_carries_across_batches(spark, tmp_dir):
    src, d = _events(spark, tmp_dir, parts=4)
    src = src.withColumn("day", F.to_date("ts"))
    stream = spark.readStream.schema(spark.read.parquet(d).schema).option("maxFilesPerTrigger", 1).parquet(d)
    # Files hold arbitrary event orders, so feed them in time order: one file per 1/4 of the time range.
    ordered = os.path.join(tmp_dir, "ordered")
    base = spark.read.parquet(d)
    qs = base.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    bounds = [-1] + qs + [10 ** 12]
    for i in range(4):
        base.filter((F.col("event_id") > bounds[i]) & (F.col("event_id") <= bounds[i + 1])).coalesce(1) \
            .write.mode("append").parquet(ordered)
        time.sleep(0.05)
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(ordered)
    schema = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, _prev timestamp_ntz"
    got = _run(spark, ev.throttle_stream_prev(stream, "user_id", "ts", "event_id", schema), tmp_dir, "append", "thr")
    assert len(got) >= 2
    streamed = {r["event_id"]: r["_prev"] for _, b in got for r in b}
    batch = with_previous(base, "user_id", ["ts", "event_id"], "_before").withColumnRenamed("_before", "_prev")
    assert streamed == {r["event_id"]: r["_prev"] for r in batch.collect()}


def _zip(path, text):
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr("a.csv", text)


def test_landing_new_by_stream_changed_by_diff(spark, tmp_dir):
    land, state, ckpt = (os.path.join(tmp_dir, x) for x in ("landing", "state", "ckpt"))
    os.makedirs(land)
    for n in ("a", "b"):
        _zip(f"{land}/{n}.zip", "x\n1\n")
    landing_stream(spark, land, state, ckpt).awaitTermination(300)
    s1 = spark.read.parquet(state)
    assert s1.select("path").distinct().count() == 2
    _zip(f"{land}/c.zip", "x\n1\n")                       # new, dropped by hand
    _zip(f"{land}/a.zip", "x\n1\n2\n3\n4\n5\n6\n")          # changed in place
    landing_stream(spark, land, state, ckpt).awaitTermination(300)
    latest = landing_state(spark, state)
    assert sorted(r[0].rsplit("/", 1)[1] for r in latest.select("path").collect()) == ["a.zip", "b.zip", "c.zip"]
    listing = (spark.read.format("binaryFile").load(land)
               .select("path", "length", F.col("modificationTime").alias("mtime")))
    diff = {r["path"].rsplit("/", 1)[1]: r["change"] for r in landing_diff(listing, s1.drop("v")).collect()}
    assert diff == {"a.zip": "changed", "b.zip": "unchanged", "c.zip": "new"}


def test_insert_or_ignore_stream_and_log_append(spark, tmp_dir):
    src = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", "event_type", "ts")
    d = os.path.join(tmp_dir, "assign")
    src.repartition(3).write.parquet(d)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(d)
    got = _run(spark, ev.insert_or_ignore_stream(stream, ["user_id", "event_type"], "ts", "3650 days"),
               tmp_dir, "append", "dedup")
    keys = [(r["user_id"], r["event_type"]) for _, b in got for r in b]
    assert len(keys) == len(set(keys)) == src.select("user_id", "event_type").distinct().count()
    q = ev.append_log_stream(spark.readStream.schema(src.schema).parquet(d).select(
        F.col("event_type").alias("level"), F.lit("stream").alias("category"),
        F.col("user_id").cast("string").alias("message")), tmp_dir + "/log", tmp_dir + "/ckpt-log")
    q.awaitTermination(300)
    log = spark.read.parquet(tmp_dir + "/log")
    assert log.count() == src.count() and log.first()["ts"].endswith("+09:00")


def test_throttle_stream_decisions_match_batch(spark, tmp_dir):
    base = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    ordered = os.path.join(tmp_dir, "req")
    bounds = [-1] + base.approxQuantile("event_id", [0.3, 0.6], 0.0) + [10 ** 12]
    for i in range(3):
        base.filter((F.col("event_id") > bounds[i]) & (F.col("event_id") <= bounds[i + 1])).coalesce(1) \
            .write.mode("append").parquet(ordered)
    complete = spark.createDataFrame([("2023_11",)], "folder string")
    args = dict(forced=F.col("event_type") == "purchase", auto_enabled=F.col("event_type") != "error",
                has_root=F.col("event_type") != "signup",
                folder=F.concat_ws("_", F.year(F.add_months(F.to_date("ts"), -2)).cast("string"),
                                   F.month(F.add_months(F.to_date("ts"), -2)).cast("string")),
                complete_folders=complete)
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(ordered)
    got = _run(spark, ev.throttle_stream(stream, "user_id", "ts", "event_id", **args), tmp_dir, "append", "thr2")
    streamed = {r["event_id"]: (r["run"], r["reason"]) for _, b in got for r in b}
    batch = {r["event_id"]: (r["run"], r["reason"])
             for r in ev.throttle(base, "user_id", "ts", "event_id", **args).collect()}
    assert streamed == batch
    assert any("already complete" in v[1] for v in batch.values())


def test_changes_stream_shows_new_changed_and_deleted_files_over_a_restart(spark, tmp_dir):
    from dropledger.streaming.landing import change_log, changes_stream, folder_listing, known_files, refresh_changes
    land, log, ckpt, sink = (os.path.join(tmp_dir, x) for x in ("landing", "log", "ckpt", "sink"))
    os.makedirs(land + "/2026_3")

    def drain():
        (changes_stream(spark, log).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start().awaitTermination(300))
        return sorted((r["v"], r["path"].rsplit("/", 1)[1], r["change"]) for r in spark.read.parquet(sink).collect())

    for n in ("a", "b", "c"):
        _zip(f"{land}/2026_3/{n}.zip", "x\n1\n")
    refresh_changes(folder_listing(spark, land), log, 1)
    first = [(1, f"{n}.zip", "new") for n in ("a", "b", "c")]
    assert drain() == first
    _zip(f"{land}/2026_3/a.zip", "x\n1\n2\n3\n4\n5\n6\n")  # changed in place
    os.remove(f"{land}/2026_3/b.zip")
    _zip(f"{land}/d.zip", "x\n1\n")
    refresh_changes(folder_listing(spark, land), log, 2)
    second = [(2, "a.zip", "changed"), (2, "b.zip", "deleted"), (2, "d.zip", "new")]
    assert drain() == first + second
    refresh_changes(folder_listing(spark, land), log, 2)  # repeated: nothing is written, nothing is shown again
    refresh_changes(folder_listing(spark, land), log, 3)  # nothing differs
    assert drain() == first + second
    assert sorted(r[0].rsplit("/", 1)[1] for r in known_files(change_log(spark, log)).select("path").collect()) == ["a.zip", "c.zip", "d.zip"]
    _zip(f"{land}/2026_3/b.zip", "x\n9\n")  # a deleted path that comes back is new
    refresh_changes(folder_listing(spark, land), log, 4)
    assert drain() == first + second + [(4, "b.zip", "new")]


def test_refresh_after_an_attempt_that_failed_before_its_commit(spark, tmp_dir):
    from dropledger.streaming.landing import CHANGE_SCHEMA, change_log, refresh_changes
    log = tmp_dir + "/log"
    S = "path string, length long, mtime long"
    refresh_changes(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 1, 1)], S), log, 1)
    assert [tuple(r) for r in change_log(spark, log).collect()] == [("a", 2, 2, "new", 1)]
    spark.createDataFrame([("stray", 1, 1, "new")], CHANGE_SCHEMA).write.parquet(log + "/v=2")
    os.remove(log + "/v=2/_SUCCESS")
    refresh_changes(spark.createDataFrame([("a", None, 2)], S), log, 2)
    got = sorted((tuple(r) for r in change_log(spark, log).collect()), key=lambda r: r[4])
    assert got == [("a", 2, 2, "new", 1), ("a", None, 2, "changed", 2)]
