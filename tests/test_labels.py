"""Labels and keys; rounding is checked against Python's formatting by brute force."""

import random

from pyspark.sql import functions as F

from dropledger.functions import text as tx


def _py_bytes(size: int) -> str:
    if size < 1024:
        return f"{size} B"
    if size < 1024 * 1024:
        return f"{size / 1024:.1f} KB"
    if size < 1024 ** 3:
        return f"{size / (1024 * 1024):.1f} MB"
    return f"{size / 1024 ** 3:.2f} GB"


def test_file_label_vector(spark):
    df = spark.createDataFrame([("東京都", int(1.5 * 1024 ** 3), 12345), ("x", 10, None)], "n string, s long, r long")
    got = [r[0] for r in df.select(tx.file_label("n", "s", "r")).collect()]
    assert got[0] == "東京都  12,345行  1.50GB"
    assert got[1] == "x  —行  0.00GB"


def test_format_bytes_matches_python(spark):
    rnd = random.Random(7)
    sizes = [0, 1, 1023, 1024, 1024 + 256, 2304, 2816, 1024 ** 2 - 1, 1024 ** 2, 5 * 1024 ** 2 + 262144,
             1024 ** 3 - 1, 1024 ** 3, 3 * 1024 ** 3 + 5 * 1024 ** 3 // 1000]
    sizes += [rnd.randrange(0, 1 << 40) for _ in range(3000)] + [rnd.randrange(0, 1 << 22) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = [r[0] for r in df.select(tx.format_bytes("s")).collect()]
    assert got == [_py_bytes(s) for s in sizes]


def test_month_year_labels(spark):
    df = spark.createDataFrame([(2026, 3, "2026_3", "complete"), (2026, 3, "2026_3", None)],
                               "y int, m int, f string, s string")
    got = [r[0] for r in df.select(tx.month_label("y", "m", "f", "s")).collect()]
    assert got == ["2026年3月分 (2026_3) [complete]", "2026年3月分 (2026_3)"]
    assert df.select(tx.year_label("y")).first()[0] == "2026年"


def test_usage_label(spark):
    df = spark.createDataFrame([(int(2.5 * 1024 ** 3), 100 * 1024 ** 3), (5, 0), (None, 7)], "a long, b long")
    got = [r[0] for r in df.select(tx.usage_label("a", "b")).collect()]
    assert got[0] == "2.50 GB / 100.00 GB（2.5% 使用）"
    assert got[1] == "0.00 GB / 0.00 GB（0.0% 使用）"
    assert got[2] == "— / —（—% 使用）"


def test_keys_and_matching(spark):
    df = spark.createDataFrame([("2026_3", "tokyo", "a.zip"), ("2026_3", "", "統合.csv"), ("2026_3", None, "b.zip")],
                               "ym string, code string, name string")
    assert [r[0] for r in df.select(tx.scope_key("ym", "code", "name")).collect()] == \
        ["2026_3/tokyo", "2026_3/統合.csv", "2026_3/b.zip"]
    p = spark.createDataFrame([("/a/b/region_a.tar.zip",)], "p string")
    assert p.select(tx.basename("p"), tx.stem("p")).first() == ("region_a.tar.zip", "region_a.tar")
    u = spark.createDataFrame([("https://x/typeB_Tokyo_2.ZIP",), ("https://x/other.zip",)], "u string")
    assert [r[0] for r in u.select(tx.link_key("u")).collect()] == ["tokyo_2", ""]
    c = spark.createDataFrame([("東京都", "東京"), ("東京", "東京都"), ("大阪", "東京")], "a string, b string")
    assert [r[0] for r in c.select(tx.contains_either("a", "b")).collect()] == [True, True, False]
    s = spark.createDataFrame([("Tokyo Region",)], "d string")
    assert s.select(tx.casefold_contains("d", F.lit("  toKYO "))).first()[0] is True


def test_export_name(spark):
    df = spark.createDataFrame([("2026_3",)], "ym string")
    got = df.select(tx.export_name("ym", F.lit("csv"), F.lit("2026-05-01 10:11:12").cast("timestamp_ntz"))).first()[0]
    assert got == "export_2026_3_20260501_101112.csv"


def test_region_master_lookups(spark):
    import pytest

    from dropledger.plans.dimension_plans import by_code, by_region
    from dropledger.plans.bindings import targets
    from tests.conftest import SF_SMALL
    m = targets(spark, SF_SMALL)
    assert m.count() == 25 and sorted(r[0] for r in m.select("target_order").collect()) == list(range(1, 26))
    assert by_code(m, "nation_3").first()["display_name"] == "NATION_3"
    with pytest.raises(KeyError):
        by_code(m, "atlantis")
    asia = [r["target_order"] for r in by_region(m, "ASIA").collect()]
    assert asia == sorted(asia) and len(asia) == 5


def test_cache_key_and_month_folders(spark):
    from dropledger.sources.jsondocs import month_folders
    df = spark.createDataFrame([("/lib/2026_3/a.zip", 10, 99), ("/lib/2026_3/b.zip", 1, 1), ("/lib/2026_4/c.zip", 1, 1)],
                               "path string, length long, mtime long")
    assert df.select(tx.cache_key("path", "length", "mtime")).first()[0] == '["/lib/2026_3/a.zip","10","99"]'
    assert sorted(r[0] for r in month_folders(df).collect()) == ["/lib/2026_3", "/lib/2026_4"]
