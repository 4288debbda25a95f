"""WARC archives as seekable Zstandard bundles.

Records are gathered into frames of about ``FRAME_BYTES``; each frame is
compressed on its own, so any one can be read without the others.  An archive
ends with the seek table (a skippable frame: compressed and plain size of each
frame, then the footer).  An index maps each record id to its archive, frame
and offset within the plain frame.

Every task writes archives of its own; their names hold the attempt, and the
index, written by Spark's committer, names those of the attempts that count.
So a lost or repeated task leaves at most a file that nothing refers to.
Archives go through ``pyarrow.fs``, to any store it has (local or shared
folders, HDFS, S3, GCS); another scheme is an error.

Records: equal payloads are stored once, by the record with the smallest page
id (``response``); the others are ``revisit`` records that refer to it.  Their
HTTP header still holds the payload's length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, prepare, read_table, scratch_uri, text_or_empty

FRAME_BYTES = 1 << 20
#: Plain bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
LEVEL = 3

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = ("record_id string, page_id string, archive string, frame int, offset long, length long, "
         "frame_start long, frame_bytes long")


def open_store(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    """The same page and payload always have the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def warc_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; with ``refers_to`` a revisit, which has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", quote(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", quote(page_id)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record, with ``http`` (fields) and ``payload`` (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record length and content differ")
    http, _, payload = block.partition(b"\r\n\r\n")
    for name in ("X-Page", "X-Refers-To-Page"):
        if name in fields:
            fields[name] = unquote(fields[name])
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields


# ---------------------------------------------------------------- archives

class ArchiveWriter:
    """Appends records to one archive; ``close`` adds the seek table."""

    def __init__(self, uri: str) -> None:
        import zstandard

        self.uri = uri
        store, path = open_store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.at, self.plain = 0, 0
        self.records: list[bytes] = []
        self.held: list[tuple[str, str | None, int, int]] = []
        self.size = 0

    def add(self, rid: str, page_id: str | None, record: bytes) -> list[tuple]:
        """Index rows of the frame that this record completes, if it does."""
        self.held.append((rid, page_id, self.size, len(record)))
        self.records.append(record)
        self.size += len(record)
        return self.flush() if self.size >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        frame = self.packer.compress(b"".join(self.records))
        self.out.write(frame)
        rows = [(rid, page, self.uri, len(self.frames), offset, length, self.at, len(frame))
                for rid, page, offset, length in self.held]
        self.frames.append((len(frame), self.size))
        self.at += len(frame)
        self.plain += self.size
        self.records, self.held, self.size = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        return rows


def read_seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer alone."""
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        end = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"no seek table: {uri}")
        entries = struct.unpack(f"<{2 * n}I", f.read_at(8 * n, end - 9 - 8 * n))
    frames, start = [], 0
    for size, plain in zip(entries[::2], entries[1::2], strict=True):
        frames.append((start, size, plain))
        start += size
    return frames


def read_frame(uri: str, start: int, size: int, plain: int) -> bytes:
    import zstandard

    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, start), max_output_size=plain)


def read_record(index_row) -> dict:
    """One record by its index row: reads its frame alone."""
    frames = read_seek_table(index_row["archive"])
    data = read_frame(index_row["archive"], *frames[index_row["frame"]])
    return parse_record(data[index_row["offset"]:index_row["offset"] + index_row["length"]])


# ---------------------------------------------------------------- on tables

def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for each page below ``folder``; return the index (one row for each record).

    A null html is an empty payload.  Of equal payloads of at least
    ``least_bytes`` bytes the page with the smallest id is the response, the
    others are revisits (rows that repeat that page's id are responses too;
    where all ids are null, so are all records).  Other columns aren't read.
    """
    prepare(pages.sparkSession)
    html = text_or_empty(F.col(f"`{html_col}`"))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("sha1"))
    first = (
        rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1")
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    known = rows.join(first, "sha1", "left").select(
        F.col("page").cast("string").alias("page"), "url", "html",
        F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).cast("string").alias("refers_to"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        names = [c.split()[0] for c in INDEX.split(", ")]
        writer, number = None, 0
        for part in parts:
            done: list[tuple] = []
            for page, url, text, refers_to in part.itertuples(index=False):
                if writer is None:
                    writer = ArchiveWriter(f"{stem}-{number}.warc.zst")
                payload = text.encode()
                digest = payload_digest(payload)
                done += writer.add(record_id(page, digest), page, warc_record(page, url, payload, digest, refers_to))
                if writer.plain >= ARCHIVE_BYTES:
                    done += writer.close()
                    writer, number = None, number + 1
            if done:
                yield pd.DataFrame(done, columns=names)
        if writer is not None and (done := writer.close()):
            yield pd.DataFrame(done, columns=names)

    return materialise(known.mapInPandas(write, INDEX), "warc-index")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives (column ``archive``), frame by frame.

    (record_id, page, type, url, payload_bytes, payload_digest, refers_to).
    Seek tables are read first, so the frames of one large archive are spread
    over tasks.  A payload that doesn't fit its digest is an error.
    """
    prepare(archives.sparkSession)

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for uri in part["archive"]:
                table = read_seek_table(uri)
                yield pd.DataFrame(table, columns=["start", "size", "plain"]).assign(archive=uri)

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for frame in part.itertuples(index=False):
                data = read_frame(frame.archive, frame.start, frame.size, frame.plain)
                out, at = [], 0
                while at < len(data):
                    body = data.index(b"\r\n\r\n", at) + 4
                    length = next(int(x.split(b": ")[1]) for x in reversed(data[at:body].split(b"\r\n"))
                                  if x.startswith(b"Content-Length: "))
                    end = body + length + 4
                    r = parse_record(data[at:end])
                    digest, payload = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload"]
                    if payload is not None and payload_digest(payload) != digest:
                        raise ValueError(f"payload and digest differ: {r['WARC-Record-ID']}")
                    out.append((r["WARC-Record-ID"], r.get("X-Page"), r["WARC-Type"], r["WARC-Target-URI"],
                                int(r["http"]["Content-Length"]) if payload is None else len(payload),
                                digest, r.get("X-Refers-To-Page")))
                    at = end
                yield pd.DataFrame(out, columns=["record_id", "page", "type", "url", "payload_bytes",
                                                 "payload_digest", "refers_to"])

    names = archives.select("archive").distinct()
    listed = names.mapInPandas(frames, "start long, size long, plain long, archive string")
    n = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return listed.repartition(n, "archive", "start").mapInPandas(
        records, "record_id string, page string, type string, url string, payload_bytes long, "
                 "payload_digest string, refers_to string")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_transform(range(0, 160), lambda i:
                ((strpos('0123456789abcdef', substr(hex, i // 4 + 1, 1)) - 1) >> (3 - i % 4)) & 1) AS bits,
             min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + 16 * bits[5 * k + 1] + 8 * bits[5 * k + 2] + 4 * bits[5 * k + 3] + 2 * bits[5 * k + 4]
              + bits[5 * k + 5] AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


@query("op6_warc", SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to seekable archives in the shared folder and read them back."""
    pages = read_table(spark, sf_dir, "pages")
    index = write_archives(pages, scratch_uri(spark, "warc"))
    id_type = pages.schema["page_id"].dataType
    return read_archives(index).select(
        F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("refers_to").cast(id_type).alias("refers_to"))
