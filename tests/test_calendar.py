"""Calendar vectors (from the reference's URL-builder tests) and our additions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dropledger.functions import calendar as cal


@pytest.mark.parametrize("today,folder", [
    ("2026-05-15", "2026_3"), ("2026-05-01", "2026_3"), ("2026-05-31", "2026_3"),
    ("2026-01-01", "2025_11"), ("2026-02-15", "2025_12"), ("2026-03-01", "2026_1"),
    ("2026-12-31", "2026_10"),
])
def test_folder_from_today(spark, today, folder):
    df = spark.createDataFrame([(dt.date.fromisoformat(today),)], "d date")
    r = df.select(cal.publish_info_from_today("d").alias("i")).first()["i"]
    assert r["folder_name"] == folder
    y, m = today[:4], today[5:7]
    assert r["publish_ym_compact"] == f"{y}{m}010000"
    assert r["dir_url"].endswith(f"/{y}{m}010000/")


@pytest.mark.parametrize("key,expected", [
    ("2026_3", (2026, 3)), ("2025_12", (2025, 12)), ("2026_03", (2026, 3)),
    ("invalid", (None, None)), ("2026_13", (None, None)), ("", (None, None)), ("2026_0", (None, None)),
])
def test_parse_month_key(spark, key, expected):
    df = spark.createDataFrame([(key,)], "k string")
    p = df.select(cal.parse_month_key("k").alias("p")).first()["p"]
    assert (p["year"], p["month"]) == expected


def test_strict_parse_raises(spark):
    df = spark.createDataFrame([("2026_13",)], "k string")
    with pytest.raises(Exception, match="Invalid folder name"):
        df.select(cal.strict_month_key("k")).collect()


def test_publish_from_folder(spark):
    df = spark.createDataFrame([("2026_3",), ("2025_11",)], "k string")
    r = [x["i"] for x in df.select(cal.publish_info_from_key("k").alias("i")).collect()]
    assert (r[0]["publish_year"], r[0]["publish_month"], r[0]["publish_ym_compact"]) == (2026, 5, "202605010000")
    assert (r[1]["publish_year"], r[1]["publish_month"]) == (2026, 1)


@pytest.mark.parametrize("y,m,d", [(2026, 1, -2), (2026, 12, 1), (2025, 3, -15), (2000, 6, 30)])
def test_shift_month_matches_integer_rule(spark, y, m, d):
    total = y * 12 + (m - 1) + d
    df = spark.createDataFrame([(y, m, d)], "y int, m int, d int")
    s = df.select(cal.shift_month("y", "m", F.col("d")).alias("s")).first()["s"]
    assert (s["year"], s["month"]) == (total // 12, total % 12 + 1)


def test_zip_url(spark):
    df = spark.createDataFrame([("202605010000", "tokyo")], "c string, k string")
    assert df.select(cal.zip_url("c", "k")).first()[0] == \
        "https://www.jartic.or.jp/d/opendata/202605010000/typeB_tokyo.zip"
