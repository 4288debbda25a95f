"""ZIP/CSV sources and sinks on small archives written in the test."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from dropledger.sources import zipcsv as zc
from tests.conftest import rows


def _zip(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", compression=zipfile.ZIP_DEFLATED) as zf:
        for name, data in members:
            zf.writestr(name, data)
    return path


def _paths(spark, paths):
    return spark.createDataFrame([("file:" + p,) for p in paths], "path string")


def _read(spark, tmp_dir, paths, block_chars=zc.BLOCK_CHARS, **how):
    return zc.read_zip_csvs(spark, _paths(spark, paths), os.path.join(tmp_dir, "stage"), block_chars, **how)


def _summary(blocks):
    return zc.archive_summary(blocks)


def test_first_csv_member_and_size(spark, tmp_dir):
    body = "a,b\n" + "1,2\n" * 100
    p = _zip(f"{tmp_dir}/2026_3/r.zip", [("readme.txt", "x"), ("dir/", ""), ("data.csv", body), ("z.CSV", "q\n")])
    r = zc.first_csv_members(_paths(spark, [p])).first()
    assert (r["member"], r["uncompressed_size"], r["error"]) == ("data.csv", len(body), None)


def test_no_csv_and_corrupt_archive(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/a.zip", [("readme.txt", "x")])
    b = f"{tmp_dir}/b.zip"
    with open(b, "wb") as fh:
        fh.write(b"garbage")
    r = {x["path"]: x for x in zc.first_csv_members(_paths(spark, [a, b])).collect()}
    assert r["file:" + a]["member"] is None and "no CSV" in r["file:" + a]["error"]
    assert "BadZipFile" in r["file:" + b]["error"]


def test_merge_two_and_three(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/a.zip", [("a.csv", "col\n1\n2\n")])
    b = _zip(f"{tmp_dir}/b.zip", [("b.csv", "col\n3\n")])
    c = _zip(f"{tmp_dir}/c.zip", [("c.csv", "col\n4\n5\n")])
    m2, _ = _read(spark, tmp_dir, [a, b])
    assert m2.drop("_source").columns == ["col"] and sorted(r[0] for r in m2.select("col").collect()) == ["1", "2", "3"]
    m3, _ = _read(spark, tmp_dir + "/x", [a, b, c])
    assert m3.count() == 5


def test_empty_list_is_an_error(spark, tmp_dir):
    with pytest.raises(ValueError):
        _read(spark, tmp_dir, [])


def test_cp932_header_and_values(spark, tmp_dir):
    text = "都道府県,件数\n13,100\n".encode("cp932")
    p = _zip(f"{tmp_dir}/j.zip", [("j.csv", text)])
    m, staged = _read(spark, tmp_dir, [p])
    assert m.drop("_source").columns == ["都道府県", "件数"]
    assert rows(m, "都道府県", "件数") == [("13", "100")]
    assert _summary(staged).first()["encoding"] == "cp932"


def test_utf8_source_falls_back(spark, tmp_dir):
    p = _zip(f"{tmp_dir}/u.zip", [("u.csv", "名前,値\n備考,1\n".encode("utf-8"))])
    m, staged = _read(spark, tmp_dir, [p])
    assert _summary(staged).first()["encoding"] == "utf-8"
    assert rows(m, "名前", "値") == [("備考", "1")]


def test_row_count_rule(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/a.zip", [("a.csv", "a,b\n1,2\n3,4\n5,6\n")])
    b = _zip(f"{tmp_dir}/b.zip", [("b.csv", "a,b\n1,2\n3,4")])           # last line without newline
    c = _zip(f"{tmp_dir}/c.zip", [("c.csv", 'a,b\n"x\ny",2\n')])          # newline inside quotes
    st = {r["path"]: r["newline_count"] for r in _summary(
        zc.stage_archives(_paths(spark, [a, b, c]), tmp_dir + "/s")).collect()}
    assert [max(st["file:" + p] - 1, 0) for p in (a, b, c)] == [3, 1, 2]


def test_header_only_first_file_and_positional_names(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/1.zip", [("a.csv", "h1,h2\n")])
    b = _zip(f"{tmp_dir}/2.zip", [("b.csv", "x,y\n1,2")])
    c = _zip(f"{tmp_dir}/3.zip", [("c.csv", "p,q\n3,4\n")])
    m, _ = _read(spark, tmp_dir, [a, b, c])
    assert m.drop("_source").columns == ["x", "y"]
    assert sorted(rows(m, "x", "y")) == [("1", "2"), ("3", "4")]


def test_arity_mismatch_fails(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/1.zip", [("a.csv", "x,y\n1,2\n")])
    b = _zip(f"{tmp_dir}/2.zip", [("b.csv", "x,y,z\n1,2,3\n")])
    with pytest.raises(ValueError, match="columns"):
        _read(spark, tmp_dir, [a, b])


def test_quote_safe_chunking_matches_single_chunk(spark, tmp_dir):
    lines = ["id,note"] + [f'{i},"line {i}\nsecond ""q"", part"' if i % 3 == 0 else f"{i},plain {i}"
                           for i in range(500)]
    p = _zip(f"{tmp_dir}/big.zip", [("big.csv", ("\n".join(lines) + "\n").encode("cp932"))])
    small, staged = _read(spark, tmp_dir + "/small", [p], block_chars=200)
    assert staged.filter("block >= 0").count() > 5
    whole, _ = _read(spark, tmp_dir + "/whole", [p])
    assert sorted(rows(small, "id", "note")) == sorted(rows(whole, "id", "note"))
    assert small.count() == 500


def test_cp932_export_unmappable_fails(spark, tmp_dir):
    p = _zip(f"{tmp_dir}/u.zip", [("u.csv", "v\n😀\n".encode())])
    _, blocks = _read(spark, tmp_dir, [p])
    with pytest.raises(Exception, match="cp932|encode"):
        zc.export_merged_cp932(blocks, tmp_dir + "/bad").collect()


HOSTILE = [
    ("0.zip", "h1,h2\n", []),                                             # no data
    ("1.zip", "a,b\n3,4", [("3", "4")]),                                   # no final line end
    ("2.zip", "a,b\r\n5,6\r\n\r\n7,8\r\n", [("5", "6"), ("7", "8")]),      # CRLF, blank line
    ("3.zip", 'a,b\n5" pipe,x\n6" pipe,"q ""r"", s"\n', [('5" pipe', "x"), ('6" pipe', 'q "r", s')]),
    ("4.zip", 'a,b\n"one\ntwo, ""three""\n",9\n"",\n', [('one\ntwo, "three"\n', "9"), (None, None)]),
    ("5 #%41日本.zip", 'a,b\nx,"y"\n', [("x", "y")]),
]


@pytest.mark.parametrize("block_chars", [1, 20, 100, zc.BLOCK_CHARS])
def test_hostile_members_read_alike_at_any_block_size(spark, tmp_dir, monkeypatch, block_chars):
    monkeypatch.setattr(zc, "READ_BLOCK", max(3, min(block_chars, 1 << 20)))
    paths = [_zip(f"{tmp_dir}/{n}", [("d.csv", text.encode("cp932"))]) for n, text, _ in HOSTILE]
    merged, blocks = _read(spark, tmp_dir, paths, block_chars)
    assert merged.columns == ["a", "b", "_source"]
    got = [(r["a"], r["b"], r["_source"]) for r in merged.collect()]
    want = [(*v, "file:" + p) for p, (_, _, values) in zip(paths, HOSTILE) for v in values]
    assert sorted(map(str, got)) == sorted(map(str, want))
    parts = zc.export_merged_cp932(blocks, tmp_dir + "/exp")
    parts.write.parquet(tmp_dir + "/parts")
    parts = spark.read.parquet(tmp_dir + "/parts")
    text = b"".join(zc.export_bytes(parts, tmp_dir + "/exp")).decode("cp932")
    import csv
    import io
    back = list(csv.reader(io.StringIO(text, newline="")))
    assert back[0] == ["a", "b"]
    assert back[1:] == [[x or "" for x in v] for p, (_, _, values) in sorted(zip(paths, HOSTILE)) for v in values]
    again = zc.read_cp932_export(parts, tmp_dir + "/exp", ["a", "b"]).select("a", "b")
    assert sorted(map(str, rows(again))) == sorted(str(v[:2]) for v in want)


@pytest.mark.parametrize("row", ["3,4,5", "3"])
def test_ragged_rows_fail_on_read_and_export(spark, tmp_dir, row):
    p = _zip(f"{tmp_dir}/r.zip", [("r.csv", f"a,b\n1,2\n{row}\n")])
    merged, blocks = _read(spark, tmp_dir, [p])
    with pytest.raises(Exception, match="(?i)malformed"):
        merged.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        zc.export_merged_cp932(blocks, tmp_dir + "/exp").collect()


def test_open_quote_is_an_error_not_a_held_member(spark, tmp_dir, monkeypatch):
    cutter = zc.RecordCutter()
    monkeypatch.setattr(zc, "MAX_RECORD_CHARS", 1000)
    with pytest.raises(ValueError, match="more than 1000"):
        for _ in range(100):
            cutter.feed('"never closed\n' if not cutter.lines else "more\n" * 10)


def test_lenient_merge_leaves_unreadable_archives_out(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/a.zip", [("a.csv", "x\n1\n")])
    b = f"{tmp_dir}/b.zip"
    with open(b, "wb") as fh:
        fh.write(b"garbage")
    with pytest.raises(ValueError, match="b.zip"):
        _read(spark, tmp_dir + "/strict", [a, b])
    merged, blocks = _read(spark, tmp_dir + "/lenient", [a, b], strict=False)
    assert rows(merged, "x") == [("1",)]
    status = {r["path"][-5:]: r["error"] for r in _summary(blocks).collect()}
    assert status["a.zip"] is None and "BadZipFile" in status["b.zip"]


def test_stats_of_odd_names_and_unknown_stores(spark, tmp_dir):
    odd = [_zip(f"{tmp_dir}/{n}", [("d.csv", "a\n1\n2\n")]) for n in ("c#1.zip", "d%41.zip", "地域 1.zip")]
    lst = zc.list_files(spark, tmp_dir)
    got = {r["path"].rsplit("/", 1)[1]: (r["row_count"], r["error"]) for r in zc.compute_file_stats(lst).collect()}
    assert got == {os.path.basename(p): (2, None) for p in odd}
    far = spark.createDataFrame([("nosuchstore://host/a.zip", 5)], "path string, length long")
    with pytest.raises(Exception, match="nosuchstore|scheme|filesystem"):
        zc.compute_file_stats(far).collect()
    assert not os.path.exists("nosuchstore:")
    missing = spark.createDataFrame([(f"file:{tmp_dir}/none.zip", 5)], "path string, length long")
    assert "FileNotFoundError" in zc.compute_file_stats(missing).first()["error"]


def test_library_listing_and_bundle_and_extract(spark, tmp_dir):
    root = tmp_dir + "/lib"
    _zip(f"{root}/2026_3/region_b.zip", [("b.csv", "region,volume\nkanagawa,200\n")])
    _zip(f"{root}/2026_3/region_a.zip", [("a.csv", "region,volume\ntokyo,100\n")])
    _zip(f"{root}/not_a_month/x.zip", [("x.csv", "a\n1\n")])
    _zip(f"{root}/2026_13/x.zip", [("x.csv", "a\n1\n")])
    _zip(f"{root}/.hidden/2026_4/x.zip", [("x.csv", "a\n1\n")])
    with open(f"{root}/2026_3/{zc.MERGED_CSV_NAME}", "w", encoding="cp932") as fh:
        fh.write("region\n")
    lst = zc.library_listing(spark, root)
    assert sorted(rows(lst, "publish_ym", "file_name", "kind")) == [
        ("2026_3", "region_a.zip", 1), ("2026_3", "region_b.zip", 1), ("2026_3", zc.MERGED_CSV_NAME, 0)]
    b = zc.bundle_months(lst, tmp_dir + "/bundles").first()
    assert (b["n_members"], b["members"]) == (2, "region_a.zip,region_b.zip")
    with zipfile.ZipFile(b["bundle"]) as zf:
        assert zf.namelist() == ["region_a.zip", "region_b.zip"]
    ex = zc.extract_archives(lst.filter(F.col("kind") == 1), tmp_dir + "/ex")
    assert sorted(rows(ex, "member")) == [("a.csv",), ("b.csv",)]
    assert os.path.isfile(tmp_dir + "/ex/2026_3/region_a/a.csv")
    zc.extract_archives(lst.filter(F.col("kind") == 1), tmp_dir + "/ex").collect()  # replaces, no error
    m, _ = zc.read_zip_csvs(spark, lst.filter(F.col("kind") == 1), tmp_dir + "/stage")
    assert sorted(rows(m, "region", "volume")) == [("kanagawa", "200"), ("tokyo", "100")]


def test_file_hashes_and_size_first_reconcile(spark, tmp_dir):
    import hashlib
    files = {}
    for name, data in (("a.zip", b"x" * 5000), ("b.zip", b"y" * 10), ("c.zip", b"z" * 10)):
        p = os.path.join(tmp_dir, name)
        with open(p, "wb") as fh:
            fh.write(data)
        files[name] = (p, hashlib.sha256(data).hexdigest(), len(data))
    paths = spark.createDataFrame([("file:" + p, n) for p, _, n in files.values()], "path string, length long")
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in zc.file_hashes(paths, block=1024).collect()}
    assert got == {k: v[1] for k, v in files.items()}
    targets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "target string")
    recorded = spark.createDataFrame([("a", files["a.zip"][1], 5000), ("b", files["c.zip"][1], 10),
                                      ("c", files["c.zip"][1], 11), ("d", "h", 1)],
                                     "target string, sha256 string, size long")
    landed = spark.createDataFrame([(k[0], "file:" + v[0], v[2]) for k, v in files.items()] + [("e", "file:/nope", 3)],
                                   "target string, path string, length long")
    r = dict(rows(zc.reconcile_files(targets, recorded, landed)))
    assert r == {"a": "skip", "b": "changed", "c": "changed", "d": "missing", "e": "new"}


def test_ordered_cp932_export_concatenates_to_one_file(spark, tmp_dir):
    a = _zip(f"{tmp_dir}/2.zip", [("b.csv", ("都道府県,件数\n" + "東京,1\n大阪,2\n" * 10).encode("cp932"))])
    b = _zip(f"{tmp_dir}/1.zip", [("a.csv", "x,y\n北海道,0\n")])
    c = _zip(f"{tmp_dir}/3.zip", [("c.csv", "p,q\n")])
    d = _zip(f"{tmp_dir}/4.zip", [("d.csv", 'p,q\n"沖\n縄",9\n')])
    _, staged = _read(spark, tmp_dir, [a, b, c, d], block_chars=8)
    parts = zc.export_merged_cp932(staged, tmp_dir + "/exp")
    assert parts.count() > 4  # small blocks: parts are cut inside archives
    data = b"".join(zc.export_bytes(parts, tmp_dir + "/exp"))
    assert data.decode("cp932") == 'x,y\n北海道,0\n' + "東京,1\n大阪,2\n" * 10 + '"沖\n縄",9\n'


def test_merge_selected_skips_when_nothing_present(spark, tmp_dir):
    root = tmp_dir + "/lib"
    _zip(f"{root}/2026_3/tokyo.zip", [("a.csv", "region,volume\ntokyo,100\n")])
    _zip(f"{root}/2026_3/osaka.zip", [("a.csv", "region,volume\nosaka,5\n")])
    lst = zc.library_listing(spark, root)
    none = spark.createDataFrame([("kyoto.zip",)], "file_name string")
    assert zc.merge_selected_archives(spark, lst, none, tmp_dir + "/s1", tmp_dir + "/m1") is None
    sel = spark.createDataFrame([("tokyo.zip",)], "file_name string")
    got = zc.merge_selected_archives(spark, lst, sel, tmp_dir + "/s2", tmp_dir + "/m2")
    assert rows(got, "region", "volume", "publish_ym") == [("tokyo", "100", "2026_3")]


def test_bundle_missing_month_is_an_error(spark, tmp_dir):
    root = tmp_dir + "/lib"
    _zip(f"{root}/2026_3/region_a.zip", [("a.csv", "x\n1\n")])
    lst = zc.library_listing(spark, root)
    assert zc.bundle_month(lst, "2026_3", tmp_dir + "/b").first()["members"] == "region_a.zip"
    with pytest.raises(FileNotFoundError):
        zc.bundle_month(lst, "2026_4", tmp_dir + "/b")


def test_staged_read_tags_rows_by_broadcast(spark, tmp_dir):
    import contextlib
    import io
    a = _zip(f"{tmp_dir}/a.zip", [("a.csv", "x\n1\n")])
    merged, _ = _read(spark, tmp_dir, [a], annotate=_paths(spark, [a]).withColumn("tag", F.lit("t")))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        merged.explain("simple")
    assert "BroadcastHashJoin" in buf.getvalue() and "SortMergeJoin" not in buf.getvalue()


@pytest.mark.parametrize("block_chars", [1, 1 << 20])
def test_blank_records_of_one_column_are_kept(spark, tmp_dir, block_chars):
    """A blank line is a record without a value where the header has one field, and no record elsewhere."""
    one = _zip(f"{tmp_dir}/one.zip", [("d.csv", "\na\n1\n\n2\n\n")])
    two = _zip(f"{tmp_dir}/two.zip", [("d.csv", "a,b\n1,2\n\n3,4\n\n")])
    assert sorted(rows(_read(spark, f"{tmp_dir}/x", [one], block_chars)[0], "a"), key=str) == [("1",), ("2",), (None,), (None,)]
    assert sorted(rows(_read(spark, f"{tmp_dir}/y", [two], block_chars)[0], "a", "b")) == [("1", "2"), ("3", "4")]


def test_csv_head_reads_the_heads_only(spark, tmp_dir):
    import random
    rnd = random.Random(3)
    body = "".join(f"{i},{rnd.random()}\n" for i in range(300_000))  # several MB that hardly compress
    big = _zip(f"{tmp_dir}/big.zip", [("readme.txt", "r"), ("b.CSV", "\ufeff" + 'a,b\n\n"1\n2","x""y"\n' + body)])
    sjis = _zip(f"{tmp_dir}/sjis.zip", [("a.csv", "県,数\n東京,1\n".encode("cp932"))])
    utf = _zip(f"{tmp_dir}/utf.zip", [("a.csv", "県,数\r\n区分 x,1".encode())])
    one = _zip(f"{tmp_dir}/one.zip", [("a.csv", "k\n1\n\n2\n")])
    none, empty = _zip(f"{tmp_dir}/none.zip", [("a.txt", "x")]), _zip(f"{tmp_dir}/empty.zip", [("a.csv", "")])
    with open(f"{tmp_dir}/broken.zip", "w") as fh:
        fh.write("no archive")
    names = ["big", "sjis", "utf", "one", "none", "empty", "broken"]
    paths = spark.createDataFrame([(f"file:{tmp_dir}/{n}.zip",) for n in names], "path string")
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in zc.csv_head(paths, 3).collect()}
    assert got["big"]["header"] == ["a", "b"] and got["big"]["records"][0] == ["1\n2", 'x"y'] and len(got["big"]["records"]) == 3
    assert got["big"]["inflated"] == zc.HEAD_BLOCK < len(body) / 100
    assert (got["sjis"]["encoding"], got["sjis"]["records"]) == ("cp932", [["東京", "1"]])
    assert (got["utf"]["encoding"], got["utf"]["header"], got["utf"]["records"]) == ("utf-8", ["県", "数"], [["区分 x", "1"]])
    assert got["one"]["records"] == [["1"], [], ["2"]]
    assert got["none"]["error"] == "no CSV member" and "BadZipFile" in got["broken"]["error"]
    assert got["empty"]["error"] is None and got["empty"]["header"] == [] and got["empty"]["records"] == []
    assert all(r["records"] == [] and r["header"] for r in zc.csv_head(paths, 0).where("size(header) > 0").collect())
    assert zc.csv_head(paths.limit(0), 3).count() == 0


def test_library_view_on_kept_statistics(spark, tmp_dir):
    """The second scan finds every file's statistics; a file that changed is measured again, one that went is forgotten."""
    from dropledger.operators.statcache import read_entries
    from dropledger.sources.library import scan_library_cached
    root, kept = tmp_dir + "/lib", tmp_dir + "/stats"
    os.makedirs(root + "/2026_3")
    _zip(f"{root}/2026_3/a.zip", [("a.csv", "x\n1\n2\n")])
    _zip(f"{root}/2026_3/b.zip", [("b.csv", "x\n1\n")])

    def view():
        v = scan_library_cached(spark, root, kept)
        return sorted(rows(v, "file_name", "row_count", "needs_stats"))

    assert view() == [("a.zip", 2, False), ("b.zip", 1, False)]
    stamp = os.stat(f"{root}/2026_3/a.zip")
    with open(f"{root}/2026_3/a.zip", "r+b") as fh:  # spoilt, but of the same size and time: it isn't opened again
        fh.write(b"XXXX")
    os.utime(f"{root}/2026_3/a.zip", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    os.remove(f"{root}/2026_3/b.zip")
    _zip(f"{root}/2026_3/c.zip", [("c.csv", "x\n1\n2\n3\n")])
    assert view() == [("a.zip", 2, False), ("c.zip", 3, False)]
    assert sorted(r[0].rsplit("/", 1)[1] for r in rows(read_entries(spark, kept), "path")) == ["a.zip", "c.zip"]


@pytest.mark.parametrize("cols", [["a", "b"], ["a"]])
def test_archives_are_written_from_lines_made_by_the_jvm(spark, tmp_dir, cols):
    """Python gets finished lines only; they are those of ``csv.writer``, and rows of an archive without a name stay out."""
    import contextlib
    import io
    fields = ["plain", "", None, "a,b", 'q "x"', '"', "l\nm", "c\rd", " s ", "#x", "県,数", "'", "\\", "a\tb"]
    data = [(ym, lab, f"{i:02d}" if len(cols) == 2 else f, f) for ym in ("2026_3", "2026_6") for lab in ("p", "q") for i, f in enumerate(fields)]
    df = spark.createDataFrame([*data, (None, "p", "x", "y"), ("2026_3", None, "x", "y")], "ym string, label string, a string, b string")
    root = f"{tmp_dir}/lib"
    enc = F.when(F.col("label") == "p", F.lit("cp932")).otherwise(F.lit("utf-8"))
    out = zc.write_archives(df.repartition(3), root, ym=F.col("ym"), label=F.col("label"), member=F.concat("label", F.lit(".csv")),
                            encoding=enc, columns=cols, order=cols)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain("simple")
    assert "MapInArrow" in buf.getvalue() and "MapInPandas" not in buf.getvalue()
    want = sorted((ym, lab, len(fields)) for ym in ("2026_3", "2026_6") for lab in ("p", "q"))
    assert sorted(rows(out, "publish_ym", "label", "rows")) == want
    assert sorted(os.listdir(root)) == ["2026_3", "2026_6"]
    for ym, lab, _ in want:
        mine = [(a, b)[:len(cols)] for y, x, a, b in data if (y, x) == (ym, lab)]
        mine.sort(key=lambda r: [(v is not None, (v or "").encode()) for v in r])
        with zipfile.ZipFile(f"{root}/{ym}/{lab}.zip") as zf:
            assert zf.namelist() == ["readme.txt", f"{lab}.csv", "extra.csv"] and zf.testzip() is None
            assert zf.read(f"{lab}.csv").decode("cp932" if lab == "p" else "utf-8") == zc._csv_text([cols, *mine])
