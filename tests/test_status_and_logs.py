"""Month status chain, check result, failure predicate, change-log folds, logs."""

import pytest
from pyspark.sql import functions as F

from dropledger.operators import changelog as cl
from dropledger.operators import outcomes as oc
from dropledger.operators.gaps import missing_months
from tests.conftest import rows


@pytest.mark.parametrize("ok,skip,fail,tc,expected", [
    (1, 1, 0, 2, "complete"), (1, 0, 1, 2, "partial"), (1, 0, 0, 51, "partial"), (0, 0, 0, 3, "pending"),
    (0, 0, 3, 3, "partial"), (5, 0, 0, 0, "pending"), (0, 2, 0, 2, "complete"),
])
def test_publication_status(spark, ok, skip, fail, tc, expected):
    df = spark.createDataFrame([(ok, skip, fail, tc)], "s int, k int, f int, t int")
    assert df.select(oc.publication_status("s", "k", "f", "t")).first()[0] == expected


@pytest.mark.parametrize("s,f,ran,expected", [(1, 1, True, "error"), (1, 0, True, "new_found"),
                                              (0, 0, True, "no_update"), (3, 0, False, "skipped")])
def test_check_result(spark, s, f, ran, expected):
    df = spark.createDataFrame([(s, 0, f, ran)], "s int, k int, f int, r boolean")
    assert df.select(oc.check_result("s", "k", "f", F.col("r"))).first()[0] == expected


def test_all_match_needs_non_empty_list(spark):
    df = spark.createDataFrame([("a", "x Executable doesn't exist"), ("a", "playwright install needed"),
                                ("b", "timeout"), ("b", "Executable doesn't exist"), ("c", None)],
                               "g string, msg string")
    member = F.col("msg").isNotNull()
    r = dict(rows(oc.all_match(df, ["g"], "msg", ["Executable doesn't exist", "playwright install"], member)))
    assert r == {"a": True, "b": False, "c": False}


def test_newline_rows(spark):
    df = spark.createDataFrame([("h\n1\n2\n",), ("h\n1\n2",), ("h",), ("",), ('h\n"a\nb"\n',)], "t string")
    assert [r[0] for r in df.select(oc.newline_rows("t")).collect()] == [2, 1, 0, 0, 2]


def test_upsert_keeps_first_detected(spark):
    log = spark.createDataFrame([("2026_3", "2026-05-01", "pending", "T1", 1),
                                 ("2026_3", "2026-05-01", "complete", "T2", 2)],
                                "ym string, d string, status string, detected string, seq int")
    r = rows(cl.fold_state(log, ["ym"], "seq", last=["status"], first=["detected"]), "ym", "status", "detected")
    assert r == [("2026_3", "complete", "T1")]


def test_tombstone_then_reinsert_starts_new_life(spark):
    log = spark.createDataFrame([("k", "a", 1, "u"), ("k", "b", 2, "u"), ("k", None, 3, "d"), ("k", "c", 4, "u"),
                                 ("k", "e", 5, "u"), ("gone", "x", 1, "u"), ("gone", None, 2, "d")],
                                "key string, v string, seq int, op string")
    log = log.withColumn("v0", F.col("v"))
    r = rows(cl.fold_state(log, ["key"], "seq", last=["v"], first=["v0"], op="op", versions="n"))
    assert r == [("k", "e", "c", 2)]


def test_toggle_parity_and_distinct(spark):
    log = spark.createDataFrame([(1, "p", "a"), (1, "p", "a"), (1, "p", "b"), (2, "f", "a")],
                                "tag int, scope string, key string")
    assert sorted(rows(cl.toggle_parity(log, ["tag", "scope", "key"]), "tag", "key")) == [(1, "b"), (2, "a")]
    assert cl.insert_or_ignore(log, ["tag", "scope", "key"]).count() == 3


def test_purge_keeps_null_stamps(spark):
    log = spark.createDataFrame([(1, "2026-01-01T00:00:00+09:00"), (2, "2026-03-01T00:00:00+09:00"), (3, None)],
                                "id int, ts string")
    kept, purged = cl.purge_before(log, "ts", "2026-02-01T00:00:00+09:00")
    assert sorted(r[0] for r in kept.collect()) == [2, 3]
    assert [r[0] for r in purged.collect()] == [1]
    far = cl.purge_before(log, "ts", "9999-01-01")[1]
    assert far.count() == 2


def test_gap_detection_vectors(spark):
    pubs = spark.createDataFrame([("2026_1", "complete"), ("2026_3", "complete"), ("2026_4", "partial"),
                                  ("2026_03", "complete")], "publish_ym string, status string")
    done = pubs.filter(F.col("status") == "complete")
    got = [r[0] for r in missing_months(spark, "2026_1", "2026_4", done).collect()]
    assert got == ["2026_2", "2026_4"]


def test_duplicates_and_orphans(spark):
    tags = spark.createDataFrame([("important",), ("important",), ("x",)], "name string")
    assert rows(cl.duplicate_keys(tags, ["name"])) == [("important", 2)]
    pubs = spark.createDataFrame([("2026_3",)], "ym string")
    files = spark.createDataFrame([("2026_3", "a"), ("2026_9", "b")], "ym string, code string")
    assert rows(cl.orphans(files, pubs, ["ym"])) == [("2026_9", "b")]


def test_append_log_stamps_and_partitions(spark, tmp_dir):
    from dropledger.operators.logs import append_log
    rows_ = spark.createDataFrame([("INFO", "test", "a"), ("ERROR", "test", "b")], "level string, category string, message string")
    append_log(rows_, tmp_dir + "/log")
    append_log(rows_.limit(1), tmp_dir + "/log")
    log = spark.read.parquet(tmp_dir + "/log")
    assert log.count() == 3
    r = log.first()
    assert r["ts"].endswith("+09:00") and len(r["ts"]) == 25 and str(r["day"]) == r["ts"][:10]


def test_stats_cache_upsert_replaces_same_key(spark):
    from dropledger.operators.reconcile import upsert_stats
    s = "path string, length long, mtime long, row_count long, uncompressed_size long"
    cache = spark.createDataFrame([("a", 1, 1, 10, 100), ("b", 1, 1, 20, 200)], s)
    fresh = spark.createDataFrame([("a", 1, 1, 11, 110), ("a", 2, 2, 12, 120)], s)
    got = sorted(tuple(r) for r in upsert_stats(cache, fresh).collect())
    assert got == [("a", 1, 1, 11, 110), ("a", 2, 2, 12, 120), ("b", 1, 1, 20, 200)]


def test_create_tags_unique_names(spark):
    from dropledger.operators.tags import create_tags
    existing = spark.createDataFrame([(1, "important", "#ff0000")], "tag_id long, name string, color string")
    new = spark.createDataFrame([("later", None), ("check", "#00ff00")], "name string, color string")
    got = sorted(rows(create_tags(existing, new), "tag_id", "name"))
    assert got == [(1, "important"), (2, "check"), (3, "later")]
    with pytest.raises(ValueError, match="important"):
        create_tags(existing, spark.createDataFrame([("important", None)], "name string, color string"))


def test_coordinated_delete_skips_files_without_code(spark):
    from dropledger.operators.tags import coordinated_delete
    S = "publish_ym string, target_code string"
    cat = spark.createDataFrame([("2026_3", "tokyo"), ("2026_3", "osaka")], S)
    man = spark.createDataFrame([("2026_3", "tokyo")], S)
    bridge = spark.createDataFrame([(1, "file", "2026_3/tokyo"), (2, "file", "2026_3/統合.csv")],
                                   "tag_id int, scope string, scope_key string")
    dset = spark.createDataFrame([("2026_3", "tokyo"), ("2026_3", None)], S)
    c, b, m, report = coordinated_delete(dset, cat, bridge, man)
    assert rows(c) == [("2026_3", "osaka")] and m.count() == 0 and rows(b, "tag_id") == [(2,)]
    assert sorted(rows(report)) == [("catalogue", 1, 1), ("manifest", 1, 0), ("tag_bridge", 1, 1)]


def test_create_tags_any_batch(spark):
    """Ids go on in name order over ranges; a name that repeats in the batch, or is null twice, is an error; an empty batch adds nothing."""
    from dropledger.operators.tags import create_tags
    S = "tag_id long, name string, color string"
    none = spark.createDataFrame([], S)
    new = spark.createDataFrame([(f"n{i:04d}", None if i % 2 else "#1") for i in range(500)][::-1], "name string, color string").repartition(7)
    got = rows(create_tags(none, new), "tag_id", "name", "color")
    assert sorted(got) == [(i + 1, f"n{i:04d}", None if i % 2 else "#1") for i in range(500)]
    old = spark.createDataFrame([(41, "x", None)], S)
    assert rows(create_tags(old, new.limit(0))) == [(41, "x", None)]
    for bad in ([("a", "1"), ("a", "2")], [(None, "1"), (None, "2")]):
        with pytest.raises(ValueError, match="already exists"):
            create_tags(old, spark.createDataFrame(bad, "name string, color string"))


def test_cascade_fold_equals_the_stores_anti_joins(spark):
    import random

    from pyspark.sql import functions as F

    from dropledger.operators.tags import cascade_fold, cascade_report, coordinated_delete
    rnd = random.Random(5)
    data = [(rnd.choice(["2026_3", "2026_4", None]), rnd.choice(["tokyo", "osaka", "kyoto", "", None]), rnd.choice(["x", "y", None]),
             rnd.choice([True, False, None]), rnd.random() < .05 or None) for _ in range(300)]
    log = spark.createDataFrame(data, "publish_ym string, target_code string, tag string, ok boolean, gone boolean")
    keys = ["publish_ym", "target_code"]
    marked = cascade_fold(log, keys, F.col("gone"), {
        "catalogue": (F.lit(True), None), "tag_bridge": (F.lit(True), F.col("tag")), "manifest": (F.col("ok"), None)})
    got = {(r["store"], r["publish_ym"], r["target_code"], r["item"]) for r in marked.where("not removed").collect()}
    doomed = {(r[0], r[1]) for r in data if r[4] and r[0] and r[1]}
    every = {("catalogue", r[0], r[1], None) for r in data} | {("manifest", r[0], r[1], None) for r in data if r[3]}
    every |= {("tag_bridge", r[0], r[1], r[2]) for r in data if r[2]}
    assert got == {e for e in every if (e[1], e[2]) not in doomed} and doomed
    stores = ["catalogue", "tag_bridge", "manifest"]
    report = {r[0]: (r[1], r[2]) for r in rows(cascade_report(marked, stores))}
    assert sum(report["catalogue"]) == len({e for e in every if e[0] == "catalogue"}) and report["catalogue"][0] == len(doomed)
    log = log.dropna(subset=keys)
    parts = coordinated_delete(log.where("gone"), log.select(*keys).distinct(),
                               log.where("tag is not null").select(F.concat_ws("/", *keys).alias("scope_key"), "tag").distinct(),
                               log.where("ok").select(*keys).distinct())
    again = cascade_fold(log, keys, F.col("gone"), {
        "catalogue": (F.lit(True), None), "tag_bridge": (F.lit(True), F.col("tag")), "manifest": (F.col("ok"), None)})
    assert sorted(rows(parts[3])) == sorted(rows(cascade_report(again, stores)))
    assert rows(cascade_report(again.limit(0), stores)) == [(s, 0, 0) for s in stores]


def test_retract_is_one_pass(spark):
    from pyspark.sql import functions as F
    log = spark.createDataFrame([("a", 1), ("a", None), ("b", 9), ("b", 1), ("c", None), (None, 2)], "k string, q int")
    assert sorted(rows(cl.retract(log, ["k"], F.col("q") >= 9)), key=str) == [("a",), ("c",), (None,)]


def test_tombstone_fold_single_pass_equals_join_path(spark):
    import random
    rnd = random.Random(11)
    data = [(f"k{rnd.randrange(30)}", rnd.randrange(10 ** 6), i, rnd.choice("uuud"), f"v{i}") for i in range(3000)]
    log = spark.createDataFrame(data, "key string, seq long, id long, op string, v string")
    fast = {tuple(r) for r in cl.fold_state(log, ["key"], ["seq", "id"], last=["v"], op="op").collect()}
    slow = {(r[0], r[1]) for r in cl.fold_state(log, ["key"], ["seq", "id"], last=["v"], op="op", versions="n").collect()}
    assert fast == slow and 0 < len(fast) < 30


def test_event_log_vectors(spark):
    from dropledger.operators.logs import log_filter
    log = spark.createDataFrame([(1, "2026-05-01T10:00:00+09:00", "DEBUG", "test", "a"),
                                 (2, "2026-05-01T10:00:01+09:00", "INFO", "test", "b"),
                                 (3, "2026-05-01T10:00:02+09:00", "ERROR", "test", "c"),
                                 (4, "2026-05-01T10:00:03+09:00", "WARN", "other", "d")],
                                "id long, ts string, level string, category string, message string")
    assert log_filter(log, level="INFO").count() == 1
    assert [r["id"] for r in log_filter(log, category="test").collect()] == [3, 2, 1]
    kept, purged = cl.purge_before(log, "ts", "9999-12-31T00:00:00+09:00")
    assert purged.count() == 4 and kept.count() == 0


def test_check_history_vectors(spark):
    from dropledger.operators.logs import latest_by, recent
    checks = spark.createDataFrame([(1, "t1", "no_update"), (2, "t2", "new_found"), (3, "t3", "error")],
                                   "id long, checked_at string, result string")
    assert latest_by(checks, "id", ["result"]).first()["result"] == "error"
    assert [r["result"] for r in recent(checks, [F.col("id").desc()], 2).collect()] == ["error", "new_found"]


def test_retention_cutoff_purges_old_rows(spark):
    import datetime as dt
    from dropledger.operators.logs import retention_cutoff
    now = dt.datetime.now(dt.timezone(dt.timedelta(hours=9)))
    iso = lambda d: d.strftime("%Y-%m-%dT%H:%M:%S+09:00")
    log = spark.createDataFrame([(1, iso(now - dt.timedelta(days=40))), (2, iso(now - dt.timedelta(days=5)))],
                                "id long, ts string")
    kept, purged = cl.purge_before(log, "ts", retention_cutoff(30))
    assert rows(kept, "id") == [(2,)] and rows(purged, "id") == [(1,)]
