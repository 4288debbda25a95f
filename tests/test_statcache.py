"""The persisted statistics cache: lookup, upsert, eviction, and which files a scan rewrites."""

import os

import pytest
from pyspark.sql import functions as F

from dropledger.operators.statcache import ENTRY, put_entries, read_entries, scan


def listed(spark, rows):
    return spark.createDataFrame(rows, "path string, length long, mtime long")


def measure(seen):
    def run(misses):
        seen.append(sorted(r.path for r in misses.collect()))
        return misses.select("path", (F.col("length") * 2).alias("row_count"), F.lit(0).cast("long").alias("uncompressed_size"))
    return run


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


@pytest.fixture()
def root(tmp_dir):
    return f"{tmp_dir}/cache"


def test_second_scan_hits_and_writes_nothing(spark, root):
    seen, rows = [], [(f"p{i}", 10 + i, 5) for i in range(40)]
    first = scan(listed(spark, rows), root, measure(seen))
    assert (first.hits, first.added, first.evicted) == (0, 40, 0) and len(seen[0]) == 40
    before = files_of(root)
    again = scan(listed(spark, rows), root, measure(seen))
    assert (again.hits, again.added, again.evicted, again.touched) == (40, 0, 0, 0) and seen[1] == []
    assert files_of(root) == before
    assert sorted(map(tuple, again.files.collect())) == [(*r, r[1], 2 * r[1], True) for r in sorted(rows)]


def test_a_changed_file_misses_and_only_its_bucket_is_rewritten(spark, root):
    rows = [(f"p{i}", 10, 5) for i in range(60)]
    scan(listed(spark, rows), root, measure([]))
    before, seen = files_of(root), []
    rows[3] = ("p3", 10, 6)  # same size, later
    step = scan(listed(spark, rows), root, measure(seen))
    assert seen == [["p3"]] and (step.hits, step.added, step.evicted, step.touched) == (59, 1, 0, 1)
    after = files_of(root)
    kept = {f for f in before if after.get(f) == before[f]}
    gone = {os.path.dirname(f) for f in before if f not in kept}
    assert len(gone) == 1 and len(kept) >= len(before) - 1
    # The entry of the old version stays as long as its path is valid, as one of another key.
    assert read_entries(spark, root).where("path = 'p3'").count() == 2


def test_eviction_of_malformed_invalid_and_missing(spark, root):
    put_entries(spark.createDataFrame([
        ("a", 1, 1, 7, 70), ("b", 1, 1, 7, None), ("b", 9, 1, 8, 0), ("gone", 1, 1, 7, 70), ("a", 1, None, 7, 70), (None, 1, 1, 7, 70),
        ("c", 1, 1, 7, 70), ("d", 1, 1, None, 3)], ENTRY), root, buckets=4)
    files = listed(spark, [("a", 1, 1), ("b", 9, 1), ("c", 1, 1), ("d", 1, 1)])
    seen = []
    out = scan(files, root, measure(seen), valid=files.where("path <> 'c'").select("path"), buckets=4)
    got = sorted(map(tuple, out.files.collect()))
    assert got == [("a", 1, 1, 70, 7, True), ("b", 9, 1, 9, 8, True), ("c", 1, 1, 70, 7, True), ("d", 1, 1, 1, 2, False)]
    assert seen == [["d"]] and out.evicted == 4  # gone, two malformed, c
    assert sorted(map(tuple, read_entries(spark, root).collect()), key=str) == [
        ("a", 1, 1, 7, 70), ("b", 1, 1, 7, None), ("b", 9, 1, 8, 0), ("d", 1, 1, 2, 0)]


def test_a_bucket_that_lost_all_entries_is_replaced(spark, root):
    scan(listed(spark, [("a", 1, 1), ("b", 1, 1)]), root, measure([]), buckets=1)
    out = scan(listed(spark, []), root, measure([]), buckets=1)
    assert out.evicted == 2 and read_entries(spark, root).count() == 0
    assert scan(listed(spark, []), root, measure([]), buckets=1).touched == 0


def test_upsert_replaces_the_same_key(spark, root):
    for count in (1, 2):
        put_entries(spark.createDataFrame([("a", 1, 1, count, 5), ("a", 2, 1, 9, 5)], ENTRY), root)
    assert sorted(map(tuple, read_entries(spark, root).collect())) == [("a", 1, 1, 2, 5), ("a", 2, 1, 9, 5)]
