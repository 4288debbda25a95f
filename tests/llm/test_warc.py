from __future__ import annotations

import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from dropledger.llm import warc as W


def pages_of(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7} é</p>" * (1 + i % 7 * 300)) for i in range(40)]
    rows += [(50, None, None), (51, "http://y/\r\nZ: 1", ""), (None, "http://n", "<p>null id</p>"), (None, "u", rows[3][2]),
             (60, "http://same", "same"), (60, "http://same", "same"), (61, "http://same", "same")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")


def want_of(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first.get(html or "") not in (i, None)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_dir, monkeypatch, least):
    rows, pages = pages_of(spark)
    index = W.write_archives(pages.repartition(3), f"file://{tmp_dir}/warc", least_bytes=least)
    back = W.read_archives(index).select(
        F.col("page").cast("long"), "payload_bytes", "payload_digest", "type", F.col("refers_to").cast("long"))
    assert sorted(str(tuple(r)) for r in back.collect()) == want_of(rows, least)
    assert index.count() == len(rows)


def test_frames_seek_table_and_index(tmp_dir, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 2000)
    uri = f"{tmp_dir}/a#1 %41.warc.zst"
    writer, index, plain = W.ArchiveWriter(uri), [], b""
    for i in range(60):
        payload = f"page {i} ".encode() * (i + 1)
        record = W.warc_record(str(i), "http://x", payload, W.payload_digest(payload), None)
        plain += record
        index += writer.add(W.record_id(str(i), W.payload_digest(payload)), str(i), record)
    index += writer.close()
    names = [c.split()[0] for c in W.INDEX.split(", ")]
    assert len(index) == 60 and index[-1][3] > 5
    for i, row in enumerate(index):
        r = W.read_record(dict(zip(names, row, strict=True)))
        assert r["payload"] == f"page {i} ".encode() * (i + 1) and r["X-Page"] == str(i)
    with open(uri, "rb") as f:  # any Zstandard reader skips the table
        stream = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
        assert io.BufferedReader(stream).read() == plain
    assert sum(p for _, _, p in W.read_seek_table(uri)) == len(plain)


def test_damage_and_unknown_stores_are_errors(tmp_dir):
    with open(f"{tmp_dir}/x", "wb") as f:
        f.write(b"0" * 100)
    with pytest.raises(ValueError):
        W.read_seek_table(f"{tmp_dir}/x")
    with pytest.raises(Exception):
        W.open_store("nosuchstore://a/b")
    with pytest.raises(ValueError):
        W.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")


def test_empty_table(spark, tmp_dir):
    _, pages = pages_of(spark)
    assert W.read_archives(W.write_archives(pages.limit(0), f"file://{tmp_dir}/none")).count() == 0
