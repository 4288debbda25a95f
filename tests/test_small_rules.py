"""Edge cases of selections, month ranges, repeated keys, state and storage."""

import pytest
from pyspark.sql import functions as F

from dropledger.operators import dims, gaps, logs, reconcile
from dropledger.sources.storage import open_store, write_file
from dropledger.streaming.landing import landing_state
from tests.conftest import rows


def test_empty_selection_is_the_whole_master(spark):
    master = spark.createDataFrame([("a", 1), ("b", 2)], "code string, target_order int")
    some = spark.createDataFrame([("b",), ("b",), ("x",)], "code string")
    assert sorted(rows(dims.select_targets(master, some.limit(0)))) == [("a", 1), ("b", 2)]
    assert rows(dims.select_targets(master, some)) == [("b", 2)]
    assert dims.select_targets(master, some.filter("code = 'x'")).count() == 0


def test_month_ranges(spark):
    assert gaps.month_spine(spark, "2026_4", "2026_1").count() == 0
    assert [r[0] for r in rows(gaps.month_spine(spark, "2025_12", "2026_2"), "publish_ym")] == ["2025_12", "2026_1", "2026_2"]
    with pytest.raises(Exception, match="2026_13"):
        gaps.month_spine(spark, "2026_1", "2026_13").collect()


def test_repeated_keys_do_not_multiply_rows(spark):
    listing = spark.createDataFrame([("p", 5, 1), ("q", 6, 1)], "path string, length long, mtime long")
    cache = spark.createDataFrame([("p", 5, 1, 3, 7)] * 2, "path string, length long, mtime long, row_count long, uncompressed_size long")
    assert reconcile.memo_lookup(listing, cache).count() == 2
    updates = spark.createDataFrame([("p", 8), ("p", 9)], "path string, length long")
    assert sorted(rows(reconcile.update_by_presence(listing, updates, "path", ["length"]))) == [("p", 9, 1), ("q", 6, 1)]


def test_landing_state_errors_are_raised(spark, tmp_dir):
    assert landing_state(spark, tmp_dir + "/none").count() == 0
    with open(tmp_dir + "/bad.parquet", "w") as fh:
        fh.write("not parquet")
    with pytest.raises(Exception):
        landing_state(spark, tmp_dir + "/bad.parquet").collect()


def test_purge_keeps_null_stamps(spark, tmp_dir):
    log = spark.createDataFrame([(1, "2024-01-01T00:00:00+09:00"), (2, "2024-03-01T00:00:00+09:00"), (3, None)], "id long, ts string")
    assert sorted(r["id"] for r in logs.purge_log(log, tmp_dir + "/v2", "ts", "2024-02").collect()) == [2, 3]


def test_storage(tmp_dir):
    assert open_store("file:/tmp/a#%41 b")[1] == "/tmp/a#%41 b" and open_store("file:///x")[1] == "/x"
    for uri in ("nosuchstore://h/x", "relative/x"):
        with pytest.raises(NotImplementedError):
            open_store(uri)
    assert write_file(f"file:{tmp_dir}/d/x", [b"ab", b"c"]) == 3
    with open(f"{tmp_dir}/d/x", "rb") as fh:
        assert fh.read() == b"abc"


def test_dimension_bound_is_the_callers(spark):
    df = spark.range(2).withColumnRenamed("id", "k")
    dim = spark.range(1500).withColumnRenamed("id", "d")
    assert dims.explode_dimension(df, dim).count() == 3000
    with pytest.raises(Exception, match="bound of 1000"):
        dims.explode_dimension(df, dim, max_rows=1000).collect()
    assert dims.explode_dimension(df, dim.filter(F.lit(False))).count() == 0


def test_compaction_in_any_batch_order(spark, tmp_dir):
    from dropledger.operators import versions
    rows_ = [("a", 1, "x", "u"), ("a", 3, None, "d"), ("a", 2, "y", "u"), ("b", 1, "p", "u"), ("b", 2, "q", "u"), ("c", 1, None, "d")]
    schema = "k string, seq int, value string, op string"
    for name, order in (("one", [0, 1, 2, 3, 4, 5]), ("two", [1, 4, 5, 0, 2, 3])):
        state = versions.read_version(spark, f"{tmp_dir}/{name}/state", 0, schema)
        for batch in (1, 2, 3):
            part = [rows_[i] for i in order[2 * batch - 2:2 * batch]]
            versions.append_changes(spark.createDataFrame(part, schema), f"{tmp_dir}/{name}/log", batch)
            changes = versions.read_changes(spark, f"{tmp_dir}/{name}/log", state.schema, batch - 1, batch)
            assert changes.count() == 2
            state = versions.compact(state, changes, f"{tmp_dir}/{name}/state", batch, ["k"], ["seq"])
        assert rows(versions.current(state)) == [("b", 2, "q")]
        assert versions.read_version(spark, f"{tmp_dir}/{name}/state", 1, schema).count() <= 2
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, f"{tmp_dir}/none", 4, schema)


def test_directory_sizes(spark):
    from dropledger.sources.zipcsv import directory_sizes
    files = spark.createDataFrame([("m1", 5), ("m1", 7), ("m2", 1), (None, 100)], "folder string, length long")
    got = sorted(rows(directory_sizes(files, F.col("folder"))))
    assert got == [("*", 3, 13), ("m1", 2, 12), ("m2", 1, 1)]
    assert rows(directory_sizes(files.limit(0), F.col("folder"))) == []


def test_master_is_checked_in_the_plan(spark):
    from pyspark.errors import SparkRuntimeException

    from dropledger.operators.dims import by_codes, checked_master
    S = "code string, filename_key string, target_order int"
    good = spark.createDataFrame([("b", "kb", 2), ("a", "ka", 1)], S)
    assert sorted(tuple(r) for r in checked_master(good).collect()) == [("a", "ka", 1), ("b", "kb", 2)]
    assert checked_master(good.limit(0)).count() == 0
    for bad, why in (([("a", "k", 1), ("a", "k", 2)], "code"), ([(None, "k", 1)], "code"),
                     ([("a", "k", 1), ("b", "k", 3)], "orders"), ([("a", "k", 1), ("b", "k", 1)], "orders"), ([("a", "k", 0)], "orders")):
        with pytest.raises(SparkRuntimeException, match=why):
            checked_master(spark.createDataFrame(bad, S)).collect()
    wanted = spark.createDataFrame([("a", 1), ("a", 2)], "code string, n int")
    assert sorted(tuple(r) for r in by_codes(good, wanted).collect()) == [("a", 1, "ka", 1), ("a", 2, "ka", 1)]
    for code in ("z", None):
        with pytest.raises(SparkRuntimeException, match="unknown target code: " + (code or "NULL")):
            by_codes(good, spark.createDataFrame([(code, 1)], "code string, n int")).collect()


def test_overrides_roundtrip_changes_one_key(spark, tmp_dir):
    from pyspark.sql import functions as F

    from dropledger.operators.dims import apply_overrides
    from dropledger.sources.jsondocs import read_overrides, write_overrides
    master = spark.createDataFrame([("tokyo", "tokyo", 1), ("osaka", "osaka", 2)], "code string, filename_key string, target_order int")
    where = tmp_dir + "/targets.json"
    load = lambda: sorted(tuple(r) for r in apply_overrides(master, read_overrides(spark, where)).drop("overridden").collect())
    assert load() == sorted(tuple(r) for r in master.collect())
    write_overrides(master.withColumn("filename_key", F.when(F.col("code") == "tokyo", "tokyo_custom").otherwise(F.col("filename_key"))), where)
    assert load() == [("osaka", "osaka", 2), ("tokyo", "tokyo_custom", 1)]
