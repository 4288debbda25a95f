"""Manifest and override documents: write, read back, tolerate bad input."""

import json
import os

from pyspark.sql import functions as F

from dropledger.operators.dims import apply_overrides
from dropledger.sources import jsondocs as jd
from tests.conftest import rows


def _doc(ym, files, version="1.0"):
    d = {"publish_ym": ym, "publish_date": "2026-05-01", "downloaded_at": "2026-05-01T10:00:00+09:00",
         "source_dir_url": "https://example.invalid/d/", "files": files}
    if version:
        d["app_version"] = version
    return d


def test_manifest_roundtrip(spark, tmp_dir):
    entry = {"target_code": "tokyo", "display_name": "東京都", "filename": "tokyo.zip", "source_url": "u",
             "size": 100, "sha256": "abc", "downloaded_at": "2026-05-01T10:00:00+09:00"}
    docs = spark.createDataFrame([("2026_3", json.dumps(_doc("2026_3", [entry]))),
                                  ("2026_4", json.dumps(_doc("2026_4", [], version=None)))],
                                 "publish_ym string, manifest_json string")
    written = jd.write_manifests(docs, tmp_dir).collect()
    assert len(written) == 2 and os.path.isfile(os.path.join(tmp_dir, "2026_3", jd.MANIFEST_FILE_NAME))
    os.makedirs(os.path.join(tmp_dir, "2026_5"))
    with open(os.path.join(tmp_dir, "2026_5", jd.MANIFEST_FILE_NAME), "w") as fh:
        fh.write("{not json")
    folders = spark.createDataFrame([(os.path.join(tmp_dir, m),) for m in ("2026_3", "2026_4", "2026_5", "2026_6")],
                                    "folder string")
    r = {x["publish_ym"]: x for x in jd.read_manifests(folders).collect()}
    assert set(r) == {"2026_3", "2026_4"}
    assert (r["2026_3"]["display_name"], r["2026_3"]["size"], r["2026_3"]["app_version"]) == ("東京都", 100, "1.0")
    assert (r["2026_4"]["target_code"], r["2026_4"]["app_version"]) == (None, "0.0.0")


def test_overrides_roundtrip_and_bad_input(spark, tmp_dir):
    master = spark.createDataFrame([("tokyo", "tokyo", 1), ("osaka", "osaka", 2)],
                                   "code string, filename_key string, target_order int")
    jd.write_overrides(master.withColumn("filename_key", F.concat("filename_key", F.lit("_custom"))),
                       tmp_dir + "/ov")
    got = apply_overrides(master, jd.read_overrides(spark, tmp_dir + "/ov"))
    assert sorted(rows(got, "code", "filename_key")) == [("osaka", "osaka_custom"), ("tokyo", "tokyo_custom")]
    with open(tmp_dir + "/hand.json", "w") as fh:
        json.dump({"version": 1, "targets": [{"code": "tokyo", "filename_key": "a"}, {"code": "tokyo"},
                                             {"code": "tokyo", "filename_key": "b"}, {"code": "nara", "filename_key": "x"}]}, fh)
    got = apply_overrides(master, jd.read_overrides(spark, tmp_dir + "/hand.json"))
    assert sorted(rows(got, "code", "filename_key", "overridden")) == [("osaka", "osaka", False), ("tokyo", "b", True)]
    with open(tmp_dir + "/bad.json", "w") as fh:
        fh.write('{"targets": "not a list"}')
    for p in (tmp_dir + "/bad.json", tmp_dir + "/absent.json"):
        assert jd.read_overrides(spark, p).count() == 0


def test_scan_library_end_to_end(spark, tmp_dir):
    import zipfile

    from dropledger.sources.library import scan_library
    root = tmp_dir + "/lib"

    def z(path, text):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with zipfile.ZipFile(path, "w") as zf:
            zf.writestr("a.csv", text)

    z(f"{root}/2026_3/tokyo.zip", "h\n1\n")
    z(f"{root}/2026_3/osaka.zip", "h\n1\n2\n")
    z(f"{root}/2026_4/nara.zip", "h\n")
    z(f"{root}/2026_5/kyoto.zip", "h\n")
    z(f"{root}/2025_12/aomori.zip", "h\n")
    entry = {"target_code": "tokyo", "display_name": "東京都", "filename": "tokyo.zip", "source_url": "u",
             "size": 1, "sha256": "h1", "downloaded_at": "t"}
    with open(f"{root}/2026_3/{jd.MANIFEST_FILE_NAME}", "w", encoding="utf-8") as fh:
        json.dump(_doc("2026_3", [entry]), fh, ensure_ascii=False)
    with open(f"{root}/2026_5/{jd.MANIFEST_FILE_NAME}", "w") as fh:
        fh.write("{broken")
    cat = spark.createDataFrame([("2026_3", "osaka", "大阪府", "x/osaka.zip", "h2", None, None, "ok"),
                                 ("2026_3", "osaka2", "大阪", "y/osaka.zip", "h3", None, None, "ok")],
                                "publish_ym string, target_code string, display_name string, file_path string, "
                                "sha256 string, source_url string, downloaded_at string, status string")
    pubs = spark.createDataFrame([("2026_3", "complete")], "publish_ym string, status string")
    v = scan_library(spark, root, catalogue=cat, publications=pubs, sort="date_asc")
    got = {(r["publish_ym"], r["file_name"]): r for r in v.collect()}
    assert ("2026_5", "kyoto.zip") not in got                         # broken manifest: folder dropped
    assert got[("2026_3", "tokyo.zip")]["display_name"] == "東京都"
    assert (got[("2026_3", "osaka.zip")]["display_name"], got[("2026_3", "osaka.zip")]["target_code"]) == ("大阪", "osaka2")
    assert got[("2026_4", "nara.zip")]["display_name"] == "nara" and got[("2026_4", "nara.zip")]["needs_stats"]
    assert got[("2026_3", "tokyo.zip")]["month_label"] == "2026年3月分 (2026_3) [complete]"
    order = sorted(got.values(), key=lambda r: (r["month_rank"], r["file_rank"]))
    assert [(r["publish_ym"], r["file_name"]) for r in order] == [
        ("2026_3", "osaka.zip"), ("2026_3", "tokyo.zip"), ("2026_4", "nara.zip"), ("2025_12", "aomori.zip")]


def test_stats_loop_misses_compute_upsert_hit(spark, tmp_dir):
    import zipfile

    from pyspark.sql import functions as F

    from dropledger.operators.reconcile import upsert_stats
    from dropledger.sources.library import scan_library
    from dropledger.sources.zipcsv import compute_file_stats
    root = tmp_dir + "/lib"
    os.makedirs(root + "/2026_3")
    with zipfile.ZipFile(root + "/2026_3/r.zip", "w", compression=zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("readme.txt", "x")
        zf.writestr("a.csv", "a,b\n" + "1,2\n" * 100)
    with open(root + "/2026_3/統合.csv", "w") as fh:
        fh.write("h\n1\n2\n3\n4\n5\n")
    v = scan_library(spark, root)
    assert sorted(r["needs_stats"] for r in v.collect()) == [True, True]
    todo = v.filter("needs_stats").select("path", F.col("display_size").alias("length"))
    stats = compute_file_stats(todo)
    got = {r["path"].rsplit("/", 1)[1]: (r["row_count"], r["display_size"]) for r in stats.collect()}
    assert got == {"r.zip": (100, len("a,b\n" + "1,2\n" * 100)), "統合.csv": (5, 12)}
    listing = v.select("path", F.col("display_size").alias("length"),
                       F.lit(None).cast("long").alias("mtime"))
    mt = spark.read.format("binaryFile").load(root + "/2026_3").select(
        "path", F.unix_micros("modificationTime").alias("mtime"))
    fresh = (stats.join(mt, "path").join(listing.drop("mtime"), "path")
             .select("path", "length", "mtime", "row_count", F.col("display_size").alias("uncompressed_size")))
    empty = spark.createDataFrame([], "path string, length long, mtime long, row_count long, uncompressed_size long")
    cache = upsert_stats(empty, fresh)
    again = {r["file_name"]: (r["needs_stats"], r["row_count"], r["file_label"]) for r in scan_library(spark, root, cache=cache).collect()}
    assert again["r.zip"][:2] == (False, 100) and again["統合.csv"][:2] == (False, 5)
    assert again["r.zip"][2].startswith("r  100行")


def test_two_folders_with_one_header_month_stay_apart(spark, tmp_dir):
    import json
    import os

    from dropledger.sources.jsondocs import MANIFEST_FILE_NAME, read_manifests
    for name, code in (("2026_3", "a"), ("copy of 2026_3", "b")):
        os.makedirs(f"{tmp_dir}/{name}")
        with open(f"{tmp_dir}/{name}/{MANIFEST_FILE_NAME}", "w", encoding="utf-8") as fh:
            json.dump({"publish_ym": "2026_3", "files": [{"target_code": code, "filename": f"{code}.zip"}]}, fh)
    folders = spark.createDataFrame([(f"file:{tmp_dir}/2026_3",), (f"file:{tmp_dir}/copy of 2026_3",)], "folder string")
    got = sorted((r["folder"].rsplit("/", 1)[1], r["target_code"]) for r in read_manifests(folders).collect())
    assert got == [("2026_3", "a"), ("copy of 2026_3", "b")]
