"""Library views: precedence merge, memo, eviction, tree order/search, manifests, links, unions."""

import pytest
from pyspark.sql import functions as F

from dropledger.functions.text import stem
from dropledger.operators import library as lib
from dropledger.operators import reconcile as rc
from tests.conftest import rows

FIELDS = ["display_name", "target_code", "sha256", "source_url", "downloaded_at"]
S = "file_name string, display_name string, target_code string, sha256 string, source_url string, downloaded_at string"


def test_precedence_is_per_row_source(spark):
    disk = spark.createDataFrame([("a.zip",), ("b.zip",), ("c.zip",)], "file_name string")
    man = spark.createDataFrame([("a.zip", "東京都", "tokyo", None, None, None)], S)
    cat = spark.createDataFrame([("a.zip", "X", "x", "h", "u", "t", "ok"), ("b.zip", "大阪府", "osaka", "h2", "u2", "t2", "ok")],
                                S + ", status string")
    r = {x["file_name"]: x for x in rc.precedence_merge(disk, man, cat, "file_name", FIELDS, stem(F.col("file_name"))).collect()}
    assert (r["a.zip"]["display_name"], r["a.zip"]["sha256"], r["a.zip"]["status"]) == ("東京都", None, "ok")
    assert (r["b.zip"]["display_name"], r["b.zip"]["sha256"], r["b.zip"]["source_kind"]) == ("大阪府", "h2", "catalogue")
    assert (r["c.zip"]["display_name"], r["c.zip"]["target_code"], r["c.zip"]["status"]) == ("c", None, None)


def test_memo_hit_and_misses(spark):
    listing = spark.createDataFrame([("p1", 100, 1), ("p2", 100, 2), ("p3", 50, 3)], "path string, length long, mtime long")
    cache = spark.createDataFrame([("p1", 100, 1, 7, 900), ("p2", 101, 2, 5, 5), ("p3", 50, 3, 2, 0)],
                                  "path string, length long, mtime long, row_count long, uncompressed_size long")
    r = {x["path"]: x for x in rc.memo_lookup(listing, cache).collect()}
    assert (r["p1"]["display_size"], r["p1"]["row_count"]) == (900, 7)
    assert (r["p2"]["display_size"], r["p2"]["row_count"], r["p2"]["cache_hit"]) == (100, None, False)  # size changed
    assert (r["p3"]["display_size"], r["p3"]["row_count"]) == (50, 2)  # zero uncompressed size → on-disk size


def test_eviction(spark):
    cache = spark.createDataFrame([("kept", 1), ("gone", 1), ("notvalid", 1), ("kept2", None)], "path string, mtime long")
    listing = spark.createDataFrame([("kept",), ("notvalid",), ("kept2",)], "path string")
    valid = spark.createDataFrame([("kept",), ("gone",), ("kept2",)], "path string")
    keep, gone = rc.evict_stale(cache, listing, valid, well_formed=F.col("mtime").isNotNull())
    assert rows(keep, "path") == [("kept",)]
    assert gone.count() == 3


def _files(spark):
    data = [(2026, 3, 1, "b.zip", "大阪"), (2026, 3, 1, "a.zip", "東京"), (2026, 3, 0, "統合.csv", "統合CSV"),
            (2026, 1, 1, "a.zip", "東京"), (2025, 12, 1, "c.zip", "Tokyo Bay")]
    return spark.createDataFrame(data, "year int, month int, kind int, file_name string, display_name string")


def _ordered(df):
    return [(r["year"], r["month"], r["file_name"]) for r in sorted(df.collect(), key=lambda r: (r["month_rank"], r["file_rank"]))]


def test_tree_orders(spark):
    f = _files(spark)
    assert _ordered(lib.tree_order(f, "date_desc")) == [
        (2026, 3, "統合.csv"), (2026, 3, "a.zip"), (2026, 3, "b.zip"), (2026, 1, "a.zip"), (2025, 12, "c.zip")]
    assert [x[:2] for x in _ordered(lib.tree_order(f, "date_asc"))][:4] == [(2026, 1), (2026, 3), (2026, 3), (2026, 3)]
    assert _ordered(lib.tree_order(f, "date_asc"))[-1] == (2025, 12, "c.zip")  # years still descend
    names = [x[2] for x in _ordered(lib.tree_order(f, "name")) if x[:2] == (2026, 3)]
    assert names == ["b.zip", "a.zip", "統合.csv"]  # 大阪 < 東京 < 統合CSV; merged file loses first place


def test_tree_search(spark):
    r = lib.search_tree(_files(spark), "  tokyo ")
    got = {(x["year"], x["month"], x["file_name"]): (x["file_visible"], x["month_visible"], x["year_visible"]) for x in r.collect()}
    assert got[(2025, 12, "c.zip")] == (True, True, True)
    assert got[(2026, 3, "a.zip")] == (False, False, False)
    assert all(v == (True, True, True) for v in
               {(x["year"], x["month"]): (x["file_visible"], x["month_visible"], x["year_visible"])
                for x in lib.search_tree(_files(spark), "  ").collect()}.values())


def test_tree_nest_roundtrip(spark):
    f = _files(spark)
    flat = lib.flatten_tree(lib.nest_tree(f, file_fields=["file_name"]))
    assert sorted(rows(flat, "year", "month", "file_name")) == sorted(rows(f, "year", "month", "file_name"))


def test_manifest_upsert_remove(spark):
    schema = "ym string, files array<struct<target_code:string, display_name:string>>"
    df = spark.createDataFrame([("2026_3", [("tokyo", "東京"), ("osaka", "大阪"), ("tokyo", "dup")])], schema)
    e = F.struct(F.lit("tokyo").alias("target_code"), F.lit("東京都").alias("display_name"))
    n = F.struct(F.lit("kyoto").alias("target_code"), F.lit("京都").alias("display_name"))
    r = df.select(lib.manifest_upsert("files", e).alias("a")).first()["a"]
    assert [x["display_name"] for x in r] == ["東京都", "大阪", "dup"]  # first match only
    r = df.select(lib.manifest_upsert("files", n).alias("a")).first()["a"]
    assert [x["target_code"] for x in r] == ["tokyo", "osaka", "tokyo", "kyoto"]
    r = df.select(lib.manifest_remove("files", F.lit("tokyo")).alias("a")).first()["a"]
    assert [x["target_code"] for x in r] == ["osaka"]


def test_first_links(spark):
    html = ('<a href="https://x/typeB_tokyo.zip">東京都</a><a href="https://x/typeB_TOKYO.zip">again</a>'
            '<a href="https://x/typeB_osaka.zip">  </a><a href="https://x/other.pdf">no</a>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = {x["link_key"]: x for x in lib.first_links(pages, "html", r"(?i)typeB_([A-Za-z0-9_]+)\.zip").collect()}
    assert set(r) == {"tokyo", "osaka"}
    assert r["tokyo"]["link_text"] == "東京都" and r["osaka"]["link_text"] == "osaka"


def test_match_links(spark):
    targets = spark.createDataFrame([("tokyo", "東京都", "tokyo"), ("osaka", "大阪府", "osaka"), ("nara", "奈良県", "nara")],
                                    "code string, display_name string, filename_key string")
    links = spark.createDataFrame([("東京都", "tokyo", 1), ("大阪", "osaka_new", 2), ("大阪府庁", "osaka_x", 3)],
                                  "display_name string, filename_key string, pos long")
    r = {x["code"]: (x["filename_key"], x["match_kind"]) for x in lib.match_links(targets, links).collect()}
    assert r == {"tokyo": ("tokyo", "exact"), "osaka": ("osaka_new", "contains"), "nara": ("nara", "none")}


def test_unions(spark):
    a = spark.createDataFrame([], "x string, y string")
    b = spark.createDataFrame([("1", "2")], "p string, q string")
    c = spark.createDataFrame([("3", "4")], "r string, s string")
    u = lib.union_positional([a, b, c])
    assert u.columns == ["p", "q"] and sorted(rows(u)) == [("1", "2"), ("3", "4")]
    with pytest.raises(ValueError):
        lib.union_positional([a])
    with pytest.raises(ValueError):
        lib.union_positional([b, spark.createDataFrame([("1",)], "z string")])
    d = spark.createDataFrame([("2", "1")], "q string, p string")
    assert sorted(rows(lib.union_by_name([b, d]), "p", "q")) == [("1", "2"), ("1", "2")]
    with pytest.raises(ValueError):
        lib.union_by_name([b, c])
    with pytest.raises(ValueError):
        lib.union_by_name([])


def test_anchors_with_markup_quotes_and_case(spark):
    html = ("<A class=x HREF='https://x/typeB_tokyo.zip'><b>東京</b>都</A><a\nhref = \"https://x/typeB_osaka.zip\" >大\n阪</a >"
            '<a href="https://x/typeB_nara.zip"><img src="n.png"></a><abbr href="https://x/typeB_no.zip">no</abbr>'
            '<a data-href="https://x/typeB_no.zip">no</a>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = {x["link_key"]: (x["url"], x["link_text"]) for x in lib.first_links(pages, "html", r"typeB_([A-Za-z0-9_]+)\.zip").collect()}
    assert r == {"tokyo": ("https://x/typeB_tokyo.zip", "東京都"), "osaka": ("https://x/typeB_osaka.zip", "大\n阪"),
                 "nara": ("https://x/typeB_nara.zip", "nara")}


def test_match_links_has_no_cap_and_takes_short_names(spark):
    targets = spark.createDataFrame([("t1", "大阪府北部", "k1"), ("t2", "ab", "k2"), ("t3", "zz", "k3"), ("t4", "link 10900", "k4")],
                                    "code string, display_name string, filename_key string")
    links = spark.range(11000).selectExpr("concat('link ', id) as display_name", "concat('l', id) as filename_key", "id as pos")
    more = spark.createDataFrame([("府", "short", 20000), ("xxabyy", "around", 20001)], links.schema)
    r = {x["code"]: (x["filename_key"], x["match_kind"]) for x in lib.match_links(targets, links.union(more)).collect()}
    assert r == {"t1": ("short", "contains"), "t2": ("around", "contains"), "t3": ("k3", "none"),
                 "t4": ("l1", "contains")}  # "link 1" is in "link 10900" and comes first


def test_search_strips_full_width_blanks(spark):
    files = spark.createDataFrame([("東京都", 2026, 3), ("大阪", 2026, 3)], "display_name string, year int, month int")
    r = {x["display_name"]: x["file_visible"] for x in lib.search_tree(files, "　東京 ").collect()}
    assert r == {"東京都": True, "大阪": False}


def test_a_common_beginning_brings_no_names_together(spark):
    """20,000 names with one beginning: candidates stay within a few times the matches."""
    names = [f"prefecture traffic count station {i:06d}" for i in range(20_000)]
    inner = spark.createDataFrame([(n,) for n in names[::4]], "part string").repartition(4)
    outer = spark.createDataFrame([(f"{n} east",) for n in names], "whole string").repartition(4)
    pairs = lib.candidates(inner, outer, "part", "whole")
    matches = pairs.filter(F.contains("whole", "part")).count()
    assert matches == 5_000 and pairs.count() <= 5 * matches
