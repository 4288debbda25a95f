"""ZIP-packed CSV drops: listing, member pick, charset fallback, merge.

Work split:
* listing is ``binaryFile`` metadata only (``content`` is never selected, so
  archives of several GB are not loaded);
* everything that touches archive bytes runs in ``mapInPandas`` tasks,
  streaming (never a whole member in memory), with archives spread over
  tasks by size (a big archive alone in its task, small ones sharing);
* a member becomes blocks of whole CSV records, each row with its archive's
  full path; Spark's own writer commits that table below the shared folder,
  so lost or doubled task attempts leave nothing behind;
* records are parsed, checked and written by the JVM (``from_csv``,
  ``to_csv``, Spark's writers).
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import itertools
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.functions.calendar import parse_month_key
from dropledger.sources.storage import open_input, open_store, write_file

# Charset order tried when decoding, names in a month folder.
ENCODINGS = ("cp932", "shift_jis", "utf-8")
MERGED_CSV_NAME = "統合.csv"
MERGED_CSV_DISPLAY = "統合CSV"
MONTH_DIR_PATTERN = r"/(\d{4}_\d{1,2})/[^/]+$"

READ_BLOCK = 1 << 20
BLOCK_CHARS = 1 << 20
#: A record longer than this is an error (most likely a quote that never closes), not a reason to hold the member.
MAX_RECORD_CHARS = 64 << 20


def local_path(uri: str) -> str:
    """Path of a local file that Spark listed; another store is an error."""
    from pyarrow import fs

    store, path = open_store(uri)
    if not isinstance(store, fs.LocalFileSystem):
        raise NotImplementedError(f"not a local file: {uri}")
    return path


# --- listing ------------------------------------------------------------------

def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of every file below ``root``; no content is read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", "length", "modificationTime")


def library_listing(spark: SparkSession, root: str) -> DataFrame:
    """Month folders of a library root and the files the library shows.

    Skips dot-directories and folders whose name is not a valid ``YYYY_M``
    key (bad month included); keeps ``*.zip`` and the merged CSV, the merged
    file first (kind 0) then archives by name.
    """
    files = list_files(spark, root)
    rel = F.substring_index(F.col("path"), "/", -2)
    ym = F.regexp_extract("path", MONTH_DIR_PATTERN, 1)
    name = F.substring_index(F.col("path"), "/", -1)
    df = files.select("path", "length", "modificationTime", ym.alias("publish_ym"), name.alias("file_name"), rel.alias("_rel"))
    p = parse_month_key(F.col("publish_ym"))
    low = F.lower("file_name")
    kind = F.when(F.col("file_name") == MERGED_CSV_NAME, F.lit(0)).when(low.endswith(".zip"), F.lit(1))
    dot_dir = F.col("path").rlike(r"/\.[^/]*/")
    return (df.withColumn("kind", kind)
            .filter(F.col("kind").isNotNull() & ~dot_dir & p["month"].isNotNull())
            .select("path", "publish_ym", p["year"].alias("data_year"), p["month"].alias("data_month"),
                    "file_name", "kind", "length", "modificationTime"))


def directory_sizes(files: DataFrame, folder: Column) -> DataFrame:
    """(folder, files, bytes) for each folder of a listing and, with folder ``*``, in total; no files, no rows."""
    named = files.select(folder.alias("folder"), "length").filter(F.col("folder").isNotNull())
    return named.rollup("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).select(
        F.coalesce("folder", F.lit("*")).alias("folder"), "files", F.coalesce("bytes", F.lit(0)).alias("bytes"))


# --- archive members ------------------------------------------------------------

MEMBER_SCHEMA = ("path string, member string, ord int, is_dir boolean, file_size long, "
                 "compress_size long, error string")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for uri in b["path"]:
            try:
                with open_input(uri) as fh, zipfile.ZipFile(fh) as zf:
                    for i, info in enumerate(zf.infolist()):
                        out.append((uri, info.filename, i, info.is_dir(), info.file_size, info.compress_size, None))
            except (OSError, zipfile.BadZipFile, ValueError) as exc:
                out.append((uri, None, None, None, None, None, f"{type(exc).__name__}: {exc}"))
        yield pd.DataFrame(out, columns=["path", "member", "ord", "is_dir", "file_size", "compress_size", "error"])


TASK_BYTES = 128 << 20


def _spread(paths: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Spread archives over tasks by size.

    The number of tasks is the larger of (total bytes / ``task_bytes``) and
    twice the cluster's default parallelism, capped at one task per archive.
    Archives are dealt round-robin in descending size order, so an archive
    bigger than ``task_bytes`` ends up alone in its task while small ones
    share.  The listing is one row per file, so the window ranking it and the
    one-row aggregate sizing it are cheap.  Without a ``length`` column every
    archive gets its own task.
    """
    if "length" not in paths.columns:
        n = max(1, paths.count())
        return paths.repartition(n, "path")
    stats = paths.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    n_arch, total = stats["n"] or 0, stats["bytes"] or 0
    par = paths.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(n_arch, max(-(-total // task_bytes), 2 * par)))
    rank = F.row_number().over(Window.orderBy(F.col("length").desc(), F.col("path"))) - 1
    return paths.withColumn("_bin", rank % n).repartitionByRange(n, "_bin").drop("_bin")


def archive_members(paths: DataFrame) -> DataFrame:
    """Member listing of every archive (archive order ``ord``); unreadable → an error row."""
    cols = ["path", "length"] if "length" in paths.columns else ["path"]
    return _spread(paths.select(*cols)).select("path").mapInPandas(_members, MEMBER_SCHEMA)


def first_csv_members(paths: DataFrame) -> DataFrame:
    """Per archive: the first member (archive order) named ``*.csv`` that is no
    directory, with its uncompressed size; none / bad archive → NULL + error."""
    m = archive_members(paths)
    is_csv = F.lower("member").endswith(".csv") & ~F.coalesce("is_dir", F.lit(False))
    firsts = (m.filter(is_csv).groupBy("path")
              .agg(F.min_by(F.struct("member", "file_size"), F.col("ord")).alias("f")))
    errs = m.groupBy("path").agg(F.max("error").alias("error"))
    return (errs.join(firsts, "path", "left")
            .select("path", F.col("f.member").alias("member"), F.col("f.file_size").alias("uncompressed_size"),
                    F.coalesce("error", F.when(F.col("f").isNull(), F.lit("no CSV member"))).alias("error")))


# --- blocks of records: decode with fallback, cut at record ends --------------------

BLOCK_SCHEMA = ("path string, member string, uncompressed_size long, encoding string, header string, "
                "n_fields int, newline_count long, has_data boolean, block long, records array<string>, error string")
_BLOCK_COLS = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def _open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``; a quote opens only at a field's start."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
            at = line.find(",", at)  # what stands behind the closing quote belongs to the field
            if at < 0:
                return False
            at += 1
        if line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(',"', at)
        if at < 0:
            return False
        at += 1


class RecordCutter:
    """Cuts decoded text into CSV records, whatever the pieces it comes in."""

    def __init__(self) -> None:
        self.parts: list[str] = []  # of a line that isn't complete
        self.lines: list[str] = []  # of a record with an open quote
        self.held = 0

    def feed(self, text: str) -> list[str]:
        first, *lines = text.split("\n")
        self.parts.append(first)
        self.held += len(first)
        if self.held > MAX_RECORD_CHARS:
            raise ValueError(f"a record of more than {MAX_RECORD_CHARS} characters (a quote that never closes?)")
        if not lines:
            return []
        lines.insert(0, "".join(self.parts))
        self.parts = [lines.pop()]
        records = []
        if not self.lines and '"' not in text and '"' not in lines[0]:
            records = lines
        else:
            for line in lines:
                if '"' in line or self.lines:
                    still_open = _open_after(line, bool(self.lines))
                    self.lines.append(line)
                    if still_open:
                        continue
                    line = "\n".join(self.lines)
                    self.lines = []
                records.append(line)
        self.held = len(self.parts[0]) + sum(map(len, self.lines))
        return [x.removesuffix("\r") for x in records]

    def end(self) -> list[str]:
        """The last record, if no line end follows it."""
        record = "\n".join([*self.lines, "".join(self.parts)]).removesuffix("\r")
        self.parts, self.lines = [], []
        return [record] if record else []


def _decoded(zf: zipfile.ZipFile, member: str, encoding: str, counts: dict | None = None) -> Iterator[str]:
    dec = codecs.getincrementaldecoder(encoding)("strict")
    with zf.open(member) as fh:
        while block := fh.read(READ_BLOCK):
            if counts is not None:
                counts["newlines"] += block.count(b"\n")
            yield dec.decode(block)
        yield dec.decode(b"", final=True)


def _member_encoding(zf: zipfile.ZipFile, member: str, encodings: Sequence[str]) -> tuple[str, int]:
    """(first encoding that decodes the whole member, newline bytes); nothing is kept."""
    last: Exception | None = None
    for enc in encodings:
        counts = {"newlines": 0}
        try:
            for _ in _decoded(zf, member, enc, counts):
                pass
            return enc, counts["newlines"]
        except UnicodeDecodeError as exc:
            last = exc
    raise ValueError(f"could not decode with {', '.join(encodings)}: {last}")


def _first_csv(zf: zipfile.ZipFile):
    for info in zf.infolist():
        if info.filename.lower().endswith(".csv") and not info.is_dir():
            return info
    return None


def _archive_blocks(uri: str, block_chars: int, encodings: Sequence[str]) -> Iterator[tuple]:
    """The archive's blocks of records, then (block -1) what is known of the whole."""
    member = size = None
    try:
        with open_input(uri) as raw, zipfile.ZipFile(raw) as zf:
            info = _first_csv(zf)
            if info is None:
                yield (uri, None, None, None, None, None, None, False, -1, [], "no CSV member")
                return
            member, size = info.filename, info.file_size
            enc, newlines = _member_encoding(zf, member, encodings)
            cutter, header, held, chars, number, n_fields = RecordCutter(), None, [], 0, 0, 0
            for text in _decoded_then_end(zf, member, enc):
                records = iter(cutter.end() if text is None else cutter.feed(text))
                if header is None and (header := next((r for r in records if r), None)) is not None:
                    header = header.removeprefix("\ufeff")
                    n_fields = len(next(csv.reader(io.StringIO(header, newline=""))))
                for r in records:
                    if not r and n_fields != 1:  # a blank line; in a table of one column it is a record without a value
                        continue
                    held.append(r)
                    chars += len(r)
                    if chars >= block_chars:
                        yield (uri, member, None, None, None, None, None, True, number, held, None)
                        held, chars, number = [], 0, number + 1
            if held:
                yield (uri, member, None, None, None, None, None, True, number, held, None)
                number += 1
            yield (uri, member, size, enc, header or "", n_fields, newlines, number > 0, -1, [], None)
    except (OSError, zipfile.BadZipFile, ValueError) as exc:
        yield (uri, member, size, None, None, None, None, False, -1, [], f"{type(exc).__name__}: {exc}")


def _decoded_then_end(zf: zipfile.ZipFile, member: str, encoding: str) -> Iterator[str | None]:
    yield from _decoded(zf, member, encoding)
    yield None


def record_blocks(paths: DataFrame, block_chars: int = BLOCK_CHARS, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Blocks of whole records of each archive's first CSV member (archives spread by size).

    Two streaming passes over a member: one finds the encoding (cp932, then
    shift_jis, then utf-8) that decodes all of it, one emits the records
    behind the header.  Blank lines are no records, but for members of one
    column, where they are records whose value is NULL.  The row with block -1 sums up the archive; its
    ``error`` says why an archive can't be read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["path"]:
                for row in _archive_blocks(uri, block_chars, encodings):
                    yield pd.DataFrame([row], columns=_BLOCK_COLS)

    cols = ["path", "length"] if "length" in paths.columns else ["path"]
    return _spread(paths.select(*cols)).select("path").mapInPandas(run, BLOCK_SCHEMA)


HEAD_SCHEMA = ("path string, member string, encoding string, header array<string>, records array<array<string>>, "
               "inflated long, error string")
HEAD_BLOCK = 16 * 1024


def _first_records(blocks: Iterator[bytes], encoding: str, n: int) -> tuple[str | None, list[str]]:
    """The header and the first ``n`` records behind it; no block is asked for beyond those that hold them."""
    dec, cutter = codecs.getincrementaldecoder(encoding)("strict"), RecordCutter()
    header, records, n_fields = None, [], 0
    for block in itertools.chain(blocks, [None]):
        cut = cutter.feed(dec.decode(block or b"", final=block is None))
        if block is None:
            cut += cutter.end()
        for r in cut:
            if header is None:
                if r:
                    header = r.removeprefix("\ufeff")
                    n_fields = len(next(csv.reader(io.StringIO(header, newline=""))))
            elif (r or n_fields == 1) and len(records) < n:
                records.append(r)
        if header is not None and len(records) >= n:
            break
    return header, records


def _archive_head(uri: str, n: int, encodings: Sequence[str]) -> tuple:
    member, seen = None, []
    try:
        with open_input(uri) as raw, zipfile.ZipFile(raw) as zf:
            info = _first_csv(zf)
            if info is None:
                return (uri, None, None, None, [], 0, "no CSV member")
            member = info.filename
            with zf.open(info) as fh:
                def blocks() -> Iterator[bytes]:
                    yield from tuple(seen)
                    while block := fh.read(HEAD_BLOCK):
                        seen.append(block)
                        yield block

                for enc in encodings:
                    try:
                        header, records = _first_records(blocks(), enc, n)
                        break
                    except UnicodeDecodeError as exc:
                        last = exc
                else:
                    raise ValueError(f"could not decode with {', '.join(encodings)}: {last}")
            fields = [next(csv.reader(io.StringIO(r, newline="")), []) for r in ([header] if header else []) + records]
            return (uri, member, enc, fields[0] if fields else [], fields[1:], sum(map(len, seen)), None)
    except (OSError, zipfile.BadZipFile, ValueError) as exc:
        return (uri, member, None, None, [], sum(map(len, seen)), f"{type(exc).__name__}: {exc}")


def csv_head(paths: DataFrame, n: int, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Preview of archives: header and first ``n`` records (as fields) of the first CSV member, a row for each archive.

    A member is inflated block by block until the records are there, so an
    archive costs its head, whatever its size (``inflated`` says how many
    bytes).  The encoding is the first that decodes what was read; later bytes
    may tell otherwise (:func:`record_blocks` reads all of them).  Blank lines
    count as in :func:`record_blocks`; what can't be read has an ``error``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["path"]:
                yield pd.DataFrame([_archive_head(uri, n, encodings)], columns=[c.split()[0] for c in HEAD_SCHEMA.split(", ")])

    return _spread(paths.select("path")).select("path").mapInPandas(run, HEAD_SCHEMA)


def stage_archives(paths: DataFrame, stage_dir: str, block_chars: int = BLOCK_CHARS,
                   encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Write the record blocks below ``stage_dir`` (Spark's writer) and read them back."""
    where = stage_dir.rstrip("/") + "/blocks"
    record_blocks(paths, block_chars, encodings).write.mode("overwrite").parquet(where)
    return paths.sparkSession.read.schema(BLOCK_SCHEMA).parquet(where)


def archive_summary(blocks: DataFrame) -> DataFrame:
    """One row for each archive: member, size, encoding, header, counts, error."""
    return blocks.filter(F.col("block") == -1).drop("block", "records")


def canonical_header(blocks: DataFrame, strict: bool = True) -> list[str]:
    """Column names from the first archive (by path) that has data rows.

    One aggregate over the per-archive summary.  Every archive with data must
    have as many columns; unless ``strict`` is off, an archive that can't be
    read is an error (else it is left out, and ``archive_summary`` names it).
    """
    data = F.col("has_data") & F.col("error").isNull()
    r = archive_summary(blocks).agg(
        F.min_by(F.col("header"), F.when(data, F.col("path"))).alias("header"),
        F.min(F.when(data, F.col("n_fields"))).alias("lo"), F.max(F.when(data, F.col("n_fields"))).alias("hi"),
        F.min_by(F.struct("path", "error"), F.when(F.col("error").isNotNull(), F.col("path"))).alias("err"),
    ).first()
    if strict and r["err"] is not None:
        raise ValueError(f"cannot read {r['err']['path']}: {r['err']['error']}")
    if r["header"] is None:
        raise ValueError("no CSV with data rows to merge")
    names = next(csv.reader(io.StringIO(r["header"], newline="")))
    if r["lo"] != r["hi"]:
        raise ValueError(f"CSV members differ in column count ({r['lo']} vs {r['hi']} columns)")
    return names


_CSV = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


def _names_ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def _data_blocks(blocks: DataFrame, strict: bool) -> DataFrame:
    """Blocks of the archives that could be read to their end (``strict`` has found no other)."""
    if strict:
        return blocks.filter(F.col("block") >= 0)
    failed = archive_summary(blocks).filter(F.col("error").isNotNull()).select("path")
    return blocks.filter(F.col("block") >= 0).join(failed, "path", "left_anti")


def _parsed(record: str, names: Sequence[str]) -> Column:
    """The record's fields; a blank record (of one column) has none, so its field is NULL."""
    return F.when(F.col(record) != "", F.from_csv(record, F.lit(_names_ddl(names)), _CSV))


def read_staged(blocks: DataFrame, annotate: DataFrame | None = None, source_col: str | None = "_source",
                strict: bool = True) -> DataFrame:
    """Positional union of all members as an all-string DataFrame.

    Names come from the first archive with data; a row with more or fewer
    fields is an error.  Each block carries its archive's full path, so rows
    are tagged with the columns of ``annotate`` (keyed by ``path``), else with
    the path as ``source_col``.
    """
    names = canonical_header(blocks, strict)
    data = _data_blocks(blocks, strict)
    if annotate is not None:
        data = data.join(annotate.select("path", *[F.col(f"`{c}`").alias(f"_tag_{i}") for i, c in
                                                   enumerate(c for c in annotate.columns if c != "path")]), "path")
        tags = [F.col(f"_tag_{i}").alias(c) for i, c in enumerate(c for c in annotate.columns if c != "path")]
    else:
        tags = []
    if source_col:
        tags.append(F.col("path").alias(source_col))
    rows = data.withColumn("_record", F.explode("records")).withColumn(
        "_r", _parsed("_record", names))
    return rows.select(*[F.col("_r").getField(n).alias(n) for n in names], *tags)


def read_zip_csvs(spark: SparkSession, paths: DataFrame, stage_dir: str,
                  block_chars: int = BLOCK_CHARS, annotate: DataFrame | None = None,
                  source_col: str | None = "_source", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(merged rows, blocks) for the archives in ``paths``; ``archive_summary(blocks)`` tells each one's status."""
    blocks = stage_archives(paths, stage_dir, block_chars)
    if annotate is not None:  # as a table of its own its true size is known, so a small one is broadcast
        where = stage_dir.rstrip("/") + "/tags"
        annotate.write.mode("overwrite").parquet(where)
        annotate = spark.read.schema(annotate.schema).parquet(where)
    return read_staged(blocks, annotate, source_col, strict), blocks


# --- sinks ----------------------------------------------------------------------------

def write_merged(df: DataFrame, dest: str, partition_by: str = "publish_ym", fmt: str = "parquet") -> None:
    """Merged dataset, partitioned by month; only the months present are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).format(fmt).save(dest))


def _csv_text(rows) -> str:
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator="\n")
    w.writerows(["" if v is None else v for v in r] for r in rows)
    return buf.getvalue()


def _extract_fn(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uri in b["path"]:
                p = local_path(uri)
                stem_ = os.path.splitext(os.path.basename(p))[0]
                sub = os.path.basename(os.path.dirname(p))
                target = os.path.join(root, sub, stem_)
                own = f"{target}.{uuid.uuid4().hex}.tmp"  # of this attempt alone
                with open_input(uri) as raw, zipfile.ZipFile(raw) as zf:
                    for info in zf.infolist():
                        dest = zf.extract(info, own)
                        out.append((uri, info.filename, os.path.getsize(dest) if not info.is_dir() else 0))
                if os.path.isdir(target):
                    shutil.rmtree(target)  # replace an earlier extraction
                os.makedirs(own, exist_ok=True)  # an archive without members
                os.rename(own, target)
            yield pd.DataFrame(out, columns=["path", "member", "size"])
    return run


def extract_archives(paths: DataFrame, root: str) -> DataFrame:
    """Extract every member of every archive under ``root/<month>/<stem>/``."""
    cols = ["path", "length"] if "length" in paths.columns else ["path"]
    return _spread(paths.select(*cols)).select("path").mapInPandas(
        _extract_fn(root), "path string, member string, size long")


def _bundle_fn(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[str, list[str]] = {}
        for b in batches:
            for ym, uri in zip(b["publish_ym"], b["path"]):
                groups.setdefault(ym, []).append(uri)
        out = []
        for ym, uris in groups.items():
            dest = os.path.join(root, f"{ym}.zip")
            own = f"{dest}.{uuid.uuid4().hex}.tmp"  # of this attempt alone
            names = []
            with zipfile.ZipFile(own, "w", compression=zipfile.ZIP_STORED) as zf:
                for uri in sorted(uris):
                    p = local_path(uri)
                    zf.write(p, arcname=os.path.basename(p))  # streamed from disk
                    names.append(os.path.basename(p))
            os.replace(own, dest)
            out.append((ym, dest, len(names), ",".join(names)))
        yield pd.DataFrame(out, columns=["publish_ym", "bundle", "n_members", "members"])
    return run


def bundle_months(listing: DataFrame, root: str) -> DataFrame:
    """One archive per month holding its region ZIPs, sorted; one task per month.

    Only paths travel through the task; members are streamed from disk.
    A month holds at most one archive per region, so its path list is bounded.
    """
    os.makedirs(root, exist_ok=True)
    z = listing.filter(F.col("kind") == 1).select("publish_ym", "path")
    n = max(1, z.select("publish_ym").distinct().count())
    return (z.repartition(n, "publish_ym").sortWithinPartitions("publish_ym", "path")
            .mapInPandas(_bundle_fn(root), "publish_ym string, bundle string, n_members int, members string"))


# --- writing archives from a table (test fixtures and exports) ---------------------------

#: An archive is one stream of one task; zlib's fastest level takes a quarter of the default's time for a third more bytes.
ARCHIVE_LEVEL = 1


def _csv_line(columns: Sequence[str]) -> Column:
    """The row as ``csv.writer`` writes it, line end included: a field with a comma, a quote or a line end is quoted, NULL is empty."""
    fields = []
    for c in columns:
        v = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(F.coalesce(F.when(v.rlike(r'[,"\r\n]'), quoted).otherwise(v), F.lit("")))
    line = F.concat_ws(",", *fields)
    if len(fields) == 1:  # an empty line would be no record
        line = F.when(line == "", F.lit('""')).otherwise(line)
    return F.concat(line, F.lit("\n"))


def _archive_lines(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(archive key, its lines) of each stretch of lines of one archive."""
    keys, lines = batch.column("_archive"), batch.column("_line")
    runs = pc.run_end_encode(keys)
    start = 0
    for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
        yield key, lines.slice(start, end - start)
        start = end


class _ArchiveWriter:
    """One open archive at a time; lines of a key arrive contiguously."""

    def __init__(self, root: str, columns: list[str], readme: str, extra_csv: str):
        self.root, self.columns, self.readme, self.extra_csv = root, columns, readme, extra_csv
        self.key = None
        self.zf = self.member = None
        self.rows = 0
        self.done: list[tuple] = []

    def open(self, key) -> None:
        ym, label, mname, enc = key.split("\0")
        os.makedirs(os.path.join(self.root, ym), exist_ok=True)
        self.path = os.path.join(self.root, ym, f"{label}.zip")
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"  # of this attempt alone
        self.key, self.ym, self.label, self.enc, self.rows = key, ym, label, enc, 0
        self.zf = zipfile.ZipFile(self.own, "w", compression=zipfile.ZIP_DEFLATED, compresslevel=ARCHIVE_LEVEL)
        self.zf.writestr("readme.txt", self.readme)
        self.member = self.zf.open(mname, "w", force_zip64=True)
        self.member.write(_csv_text([self.columns]).encode(enc))

    def write(self, key, lines: pa.Array) -> None:
        if key != self.key:
            self.close()
            self.open(key)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "")
        self.member.write(joined[0].as_py().encode(self.enc))
        self.rows += len(lines)

    def close(self) -> None:
        if self.zf is None:
            return
        self.member.close()
        self.zf.writestr("extra.csv", self.extra_csv)
        self.zf.close()
        os.replace(self.own, self.path)
        self.done.append((self.path, self.ym, self.label, self.rows))
        self.zf = self.member = None


_WRITTEN = pa.schema([("path", pa.string()), ("publish_ym", pa.string()), ("label", pa.string()), ("rows", pa.int64())])


def _archive_fn(root: str, columns: list[str], readme: str, extra_csv: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _ArchiveWriter(root, columns, readme, extra_csv)
        for b in batches:
            for key, lines in _archive_lines(b):
                w.write(key, lines)
        w.close()
        yield pa.RecordBatch.from_pylist([dict(zip(_WRITTEN.names, x)) for x in w.done], schema=_WRITTEN)
    return run


def write_archives(df: DataFrame, root: str, ym: Column, label: Column, member: Column,
                   encoding: Column, columns: Sequence[str],
                   readme: str = "readme\n", extra_csv: str = "x\n1\n", order: Sequence[str] = ()) -> DataFrame:
    """Write one ZIP per (month, label): ``readme.txt``, the CSV member, ``extra.csv``.

    Rows are hash-partitioned on the archive key and sorted in ``order`` if
    columns are given; the JVM makes the CSV lines, and a task streams them
    into the member in Arrow batches (bounded memory), without Python work on
    a row.  Rows whose archive has no name, member or encoding are left out.
    Returns (path, publish_ym, label, rows).
    """
    nul = F.lit("\0")
    key = F.concat(ym, nul, label, nul, member, nul, encoding)  # NULL if one of them is
    keyed = df.select(key.alias("_archive"), *columns).filter(F.col("_archive").isNotNull())
    n = max(1, df.select(ym.alias("_ym"), label.alias("_label")).distinct().count())
    return (keyed.repartition(n, F.substring_index("_archive", "\0", 2)).sortWithinPartitions("_archive", *order)
            .select("_archive", _csv_line(columns).alias("_line"))
            .mapInArrow(_archive_fn(root, list(columns), readme, extra_csv),
                        "path string, publish_ym string, label string, rows long"))


# --- content hashes of landed files -----------------------------------------------------------

def _hash_fn(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uri in b["path"]:
                h, n = hashlib.sha256(), 0
                try:
                    with open_input(uri) as fh:
                        while chunk := fh.read(block):
                            h.update(chunk)
                            n += len(chunk)
                    out.append((uri, h.hexdigest(), n, None))
                except OSError as exc:
                    out.append((uri, None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["path", "sha256", "bytes", "error"])
    return run


def file_hashes(paths: DataFrame, block: int = READ_BLOCK) -> DataFrame:
    """SHA-256 of each file, streamed in 1 MiB blocks (files of any size;
    ``binaryFile`` content would stop at 2 GiB).  Files are spread by size."""
    cols = ["path", "length"] if "length" in paths.columns else ["path"]
    return _spread(paths.select(*cols)).select("path").mapInPandas(
        _hash_fn(block), "path string, sha256 string, bytes long, error string")


def reconcile_files(targets: DataFrame, recorded: DataFrame, landed: DataFrame, key: str = "target") -> DataFrame:
    """Skip / fetch decision per target against landed files (size checked first).

    ``recorded``: (key, sha256, size) from the manifest; ``landed``: (key,
    path, length) from a listing.  Only files whose size equals the recorded
    size are read and hashed; every other landed file is ``changed`` without
    being read.
    """
    r = recorded.select(F.col(key), F.col("sha256").alias("_rec"), F.col("size").alias("_rec_size"))
    f = landed.select(F.col(key), "path", "length")
    j = targets.select(key).join(r, key, "left").join(f, key, "left")
    same_size = j.filter(F.col("path").isNotNull() & (F.coalesce(F.col("_rec"), F.lit("")) != "")
                         & (F.col("length") == F.col("_rec_size")))
    hashed = file_hashes(same_size.select("path", "length")).select("path", F.col("sha256").alias("_now"))
    j = j.join(hashed, "path", "left")
    action = (F.when(F.col("path").isNull(), F.lit("missing"))
              .when(F.coalesce(F.col("_rec"), F.lit("")) == "", F.lit("new"))
              .when(F.col("_now") == F.col("_rec"), F.lit("skip"))
              .otherwise(F.lit("changed")))
    return j.select(F.col(key), action.alias("action"))


# --- ordered cp932 export ---------------------------------------------------------------

EXPORT_HEADER_NAME = "header.csv"
EXPORT_SCHEMA = "part string, path string, block long, bytes long"


def _export_fn(dest: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, stem, block, text in b[["path", "stem", "block", "text"]].itertuples(index=False):
                part = f"{dest}/part-{stem}-{int(block):012d}.csv"
                out.append((part, path, int(block), write_file(part, [text.encode("cp932", errors="strict")])))
            yield pd.DataFrame(out, columns=["part", "path", "block", "bytes"])
    return run


def export_merged_cp932(blocks: DataFrame, dest: str, strict: bool = True) -> DataFrame:
    """The merged CSV in cp932, in the reference's order: archives by path, rows
    in file order, one header (the canonical names) at the top.

    Records are parsed and written again by the JVM, so each ends with a line
    end and a ragged one is an error, as in :func:`read_staged`.  Each block is
    a part of its own, encoded (strictly) by the task that holds it; the
    returned table (part, path, block, bytes) ordered by path and block,
    behind ``header.csv``, is the file (cp932 has no state).
    """
    names = canonical_header(blocks, strict)
    write_file(f"{dest}/{EXPORT_HEADER_NAME}", [_csv_text([names]).encode("cp932", errors="strict")])
    ddl = _names_ddl(names)
    line = "transform(records, r -> if(r = '', r, to_csv(from_csv(r, '{}', {o}), {o})))".format(
        ddl.replace("\\", "\\\\").replace("'", "\\'"), o="map('quote', '\"', 'escape', '\"', 'mode', 'FAILFAST', 'ignoreLeadingWhiteSpace', 'false', "
        "'ignoreTrailingWhiteSpace', 'false')")
    texts = _data_blocks(blocks, strict).select(
        "path", F.sha2("path", 256).alias("stem"), "block", F.concat(F.array_join(F.expr(line), "\n"), F.lit("\n")).alias("text"))
    return texts.mapInPandas(_export_fn(dest.rstrip("/")), EXPORT_SCHEMA)


def export_bytes(parts: DataFrame, dest: str) -> Iterator[bytes]:
    """The exported file, piece by piece: the header, then the parts in order (names only pass the driver)."""
    yield open_input(f"{dest}/{EXPORT_HEADER_NAME}").read()
    for r in parts.select("part").orderBy("path", "block").toLocalIterator():
        yield open_input(r["part"]).read()


def read_cp932_export(parts: DataFrame, dest: str, names: Sequence[str]) -> DataFrame:
    """Rows of an export, all strings, with ``_path`` and ``_block``.

    Parts are decoded in tasks (Spark can't decode cp932) and cut into
    records; the JVM parses them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, path, block in b[["part", "path", "block"]].itertuples(index=False):
                cutter = RecordCutter()
                with open_input(part) as fh:
                    records = cutter.feed(fh.read().decode("cp932", errors="strict")) + cutter.end()
                yield pd.DataFrame([(path, int(block), records)], columns=["_path", "_block", "records"])

    records = parts.select("part", "path", "block").mapInPandas(run, "_path string, _block long, records array<string>")
    parsed = records.withColumn("_record", F.explode("records")).withColumn(
        "_r", _parsed("_record", names))
    return parsed.select(*[F.col("_r").getField(n).alias(n) for n in names], "_path", "_block")


# --- file statistics for cache misses (row count rule, display size) -----------------------

def _stats_fn(block: int):
    def newlines(fh) -> int:
        n = 0
        while chunk := fh.read(block):
            n += chunk.count(b"\n")
        return n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for uri, length in zip(b["path"], b["length"]):
                suffix = os.path.splitext(uri)[1].lower()
                rows, display, error = None, int(length), None
                try:
                    if suffix == ".csv":
                        with open_input(uri) as fh:
                            rows = max(0, newlines(fh) - 1)
                    elif suffix == ".zip":
                        with open_input(uri) as raw, zipfile.ZipFile(raw) as zf:
                            info = _first_csv(zf)
                            if info is not None:
                                display = info.file_size or display
                                with zf.open(info) as fh:
                                    rows = max(0, newlines(fh) - 1)
                except (OSError, zipfile.BadZipFile, ValueError) as exc:
                    rows, error = None, f"{type(exc).__name__}: {exc}"
                out.append((uri, rows, display, error))
            yield pd.DataFrame(out, columns=["path", "row_count", "display_size", "error"])
    return run


def compute_file_stats(files: DataFrame, block: int = READ_BLOCK) -> DataFrame:
    """(path, row_count, display_size, error) for listed files (``path``, ``length``).

    Row count = newline bytes − 1, floored at 0, for ``.csv`` files and for
    the first CSV member of a ``.zip``; other suffixes and unreadable files
    give NULL (``error`` says why).  Display size = the member's uncompressed size when non-zero,
    else the on-disk size.  Streamed in blocks; files spread over tasks by size.
    """
    return _spread(files.select("path", "length")).mapInPandas(
        _stats_fn(block), "path string, row_count long, display_size long, error string")


def merge_selected_archives(spark: SparkSession, listing: DataFrame, selected_names: DataFrame,
                            stage_dir: str, dest: str, partition_by: str = "publish_ym") -> DataFrame | None:
    """Merge the archives of the selected targets (semi join on file name,
    e.g. ``<folder_label>.zip``) into the month-partitioned dataset at ``dest``.

    No archive present → ``None`` (skipped, not an error).  Only the months
    present are replaced (dynamic partition overwrite).  Returns the merged
    dataset read back.
    """
    zips = listing.filter(F.col("kind") == 1).join(selected_names.select("file_name"), "file_name", "left_semi")
    if zips.limit(1).count() == 0:
        return None
    meta = zips.select("path", partition_by)
    merged, _ = read_zip_csvs(spark, zips.select("path", "length"), stage_dir, annotate=meta, source_col=None)
    write_merged(merged, dest, partition_by)
    return spark.read.parquet(dest)


def month_archives(listing: DataFrame, publish_ym: str, max_files: int | None = None) -> DataFrame:
    """The month's archives with ``taken``: the first ``max_files`` by path, all if there is no limit.

    Rows with ``taken`` false are what an export with that limit leaves out.
    A month lists one archive for each region.
    """
    month = listing.filter((F.col("kind") == 1) & (F.col("publish_ym") == publish_ym))
    if max_files is None:
        return month.withColumn("taken", F.lit(True))
    first = month.orderBy("path").limit(max_files).select("path", F.lit(True).alias("taken"))
    return month.join(first, "path", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def bundle_month(listing: DataFrame, publish_ym: str, root: str) -> DataFrame:
    """The bundle of one month; a month without archives is an error."""
    month = listing.filter(F.col("publish_ym") == publish_ym)
    if month.filter(F.col("kind") == 1).limit(1).count() == 0:
        raise FileNotFoundError(f"no archives for {publish_ym}")
    return bundle_months(month, root)
