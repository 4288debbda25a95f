"""JSON documents of the library: month manifests and the filename-key override list."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.functions.text import now_jst_iso
from dropledger.operators.library import explode_manifest
from dropledger.sources.zipcsv import local_path

# Manifest file name and document layouts.
MANIFEST_FILE_NAME = "_manifest.json"
MANIFEST_SCHEMA = ("publish_ym string, publish_date string, downloaded_at string, source_dir_url string, "
                   "app_version string, files array<struct<target_code:string, display_name:string, "
                   "filename:string, source_url:string, size:bigint, sha256:string, downloaded_at:string>>")
OVERRIDES_SCHEMA = "version bigint, scraped_at string, targets array<struct<code:string, filename_key:string>>"


def _read_text_fn(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for folder in b["folder"]:
                path = os.path.join(local_path(folder), name)
                try:
                    with open(path, encoding="utf-8") as fh:
                        out.append((folder, fh.read()))
                except FileNotFoundError:
                    continue  # no manifest in this folder
                except (OSError, UnicodeDecodeError):
                    out.append((folder, None))
            yield pd.DataFrame(out, columns=["folder", "text"])
    return run


def read_manifests(folders: DataFrame, default_version: str = "0.0.0") -> DataFrame:
    """The ``_manifest.json`` of every folder, exploded to one row per file entry.

    Spark's file listing hides names starting with ``_``, so each folder's
    document is read by the task holding the folder row and parsed with
    ``from_json``.  Absent documents give no rows; unreadable or invalid ones
    (or one without ``publish_ym``) are dropped; a missing ``files`` array
    gives the header row with NULL entry fields; a missing ``app_version``
    takes the default.
    """
    texts = folders.select("folder").mapInPandas(_read_text_fn(MANIFEST_FILE_NAME), "folder string, text string")
    parsed = texts.select("folder", F.from_json("text", MANIFEST_SCHEMA).alias("m"))
    ok = parsed.filter(F.col("m.publish_ym").isNotNull())
    return explode_manifest(ok, None, default_version=default_version, struct_col="m", carry=["folder"])


def month_folders(listing: DataFrame) -> DataFrame:
    """Distinct parent folders of a library listing (``path`` column)."""
    return listing.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).distinct()


def _write_manifest_fn(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in batches:
            for ym, doc in zip(b["publish_ym"], b["manifest_json"]):
                folder = os.path.join(root, ym)
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, MANIFEST_FILE_NAME)
                tmp = path + ".tmp"
                with open(tmp, "w", encoding="utf-8") as fh:
                    fh.write(json.dumps(json.loads(doc), indent=2, ensure_ascii=False))
                os.replace(tmp, path)  # atomic publish
                out.append((ym, path))
        yield pd.DataFrame(out, columns=["publish_ym", "path"])
    return run


def write_manifests(docs: DataFrame, root: str) -> DataFrame:
    """Write one ``_manifest.json`` per month folder from (publish_ym, manifest_json).

    Each document is bounded (one entry per region), written by whichever
    task holds its row, via a temp file and an atomic rename.
    """
    return docs.select("publish_ym", "manifest_json").mapInPandas(
        _write_manifest_fn(root), "publish_ym string, path string")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override entries (code, filename_key, pos) from an override document.

    Absent or invalid documents, and a ``targets`` value that is
    not a list, give no overrides (the master stays unchanged); entries
    lacking either field are ignored.  ``pos`` is the entry's position, so
    the last entry for a code wins in :func:`dims.apply_overrides`.
    """
    empty = spark.createDataFrame([], "code string, filename_key string, pos int")
    try:
        docs = (spark.read.schema(OVERRIDES_SCHEMA + ", _corrupt_record string").option("multiLine", True)
                .option("mode", "PERMISSIVE").json(path))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    ok = docs.filter(F.col("_corrupt_record").isNull() & F.col("targets").isNotNull())
    e = ok.select(F.posexplode("targets").alias("pos", "t"))
    return (e.select(F.col("t.code").alias("code"), F.col("t.filename_key").alias("filename_key"), "pos")
            .filter(F.col("code").isNotNull() & F.col("filename_key").isNotNull()))


def write_overrides(targets: DataFrame, path: str) -> None:
    """One override document (version, scraped_at = now in JST, targets[code, filename_key]).

    The region master is bounded, so the document is built by one aggregate
    and written as a single part file.
    """
    doc = targets.agg(F.sort_array(F.collect_list(F.struct(F.col("target_order"), F.col("code"),
                                                           F.col("filename_key")))).alias("t"))
    doc = doc.select(F.lit(1).cast("bigint").alias("version"),
                     now_jst_iso().alias("scraped_at"),
                     F.transform("t", lambda x: F.struct(x["code"].alias("code"),
                                                         x["filename_key"].alias("filename_key"))).alias("targets"))
    doc.coalesce(1).write.mode("overwrite").json(path)
