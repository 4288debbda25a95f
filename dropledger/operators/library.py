"""Library views: tree nesting and ordering, search, manifests, unions, links.

The library tree is small by construction: a month folder holds at most one
archive per region plus the merged file, and a year twelve months.  Windows
over a month or a year are therefore bounded and used where they save a
recomputation; facts over unbounded groups elsewhere in the engine use
partial aggregates instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropledger.functions.text import casefold_contains

# Kind ranks in a month folder (merged file listed first).
KIND_MERGED, KIND_ZIP = 0, 1


def nest_tree(files: DataFrame, year: str = "year", month: str = "month",
              file_fields: Sequence[str] = ("file_name",)) -> DataFrame:
    """Year → months → files as ``array<struct>`` columns (one row per year).

    A month holds at most one file per region and a year twelve months, so
    each collected array is bounded by the calendar and the region master.
    """
    months = (files.groupBy(year, month)
              .agg(F.sort_array(F.collect_list(F.struct(*[F.col(f) for f in file_fields]))).alias("files")))
    return (months.groupBy(year)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(month).alias("month"), F.col("files")))).alias("months")))


def flatten_tree(tree: DataFrame, year: str = "year") -> DataFrame:
    """Inverse of :func:`nest_tree`: one row per file with the nesting sizes."""
    m = tree.select(F.col(year), F.size("months").alias("year_month_count"), F.explode("months").alias("m"))
    f = m.select(year, "year_month_count", F.col("m.month").alias("month"),
                 F.size("m.files").alias("month_file_count"), F.explode("m.files").alias("f"))
    return f.select(year, "month", "f.*", "month_file_count", "year_month_count")


def tree_ranks(files: DataFrame, year: str = "year", month: str = "month", kind: str = "kind",
               name: str = "file_name", display: str = "display_name") -> DataFrame:
    """Every library order at once, as (month rank, rank inside the month).

    Years always descend; months descend (``month_rank_desc``) or ascend
    (``month_rank_asc``, the ``date_asc`` sort); inside a month the merged
    file comes first then files by name (``file_rank_date``), except the
    ``name`` sort, which orders by display name only (``file_rank_name``).
    Month ranks come from a window over the distinct months (a calendar-sized
    set); file ranks from windows per month (a month holds at most one file
    per region plus the merged file), both sharing one shuffle.
    """
    months = files.select(year, month).distinct()
    months = (months
              .withColumn("month_rank_desc", F.row_number().over(Window.orderBy(F.col(year).desc(), F.col(month).desc())))
              .withColumn("month_rank_asc", F.row_number().over(Window.orderBy(F.col(year).desc(), F.col(month).asc()))))
    per_month = Window.partitionBy(year, month)
    ranked = (files
              .withColumn("file_rank_date", F.row_number().over(per_month.orderBy(F.col(kind), F.col(name))))
              .withColumn("file_rank_name", F.row_number().over(per_month.orderBy(F.col(display)))))
    return ranked.join(months, [year, month])


def tree_order(files: DataFrame, sort: str = "date_desc", **cols) -> DataFrame:
    """One library order (``date_desc`` default, ``date_asc`` or ``name``) as
    ``month_rank`` / ``file_rank`` columns; see :func:`tree_ranks`."""
    r = tree_ranks(files, **cols)
    mr = "month_rank_asc" if sort == "date_asc" else "month_rank_desc"
    fr = "file_rank_name" if sort == "name" else "file_rank_date"
    return (r.withColumn("month_rank", F.col(mr)).withColumn("file_rank", F.col(fr))
            .drop("month_rank_desc", "month_rank_asc", "file_rank_date", "file_rank_name"))


def search_tree(files: DataFrame, needle: str, display: str = "display_name",
                year: str = "year", month: str = "month") -> DataFrame:
    """Visibility flags for a search needle (trimmed, lower-cased containment).

    Empty needle: everything visible.  A month is visible if any of its files
    matches; a year if any of its months is visible.
    """
    if not needle.strip():
        return files.select("*", F.lit(True).alias("file_visible"), F.lit(True).alias("month_visible"),
                            F.lit(True).alias("year_visible"))
    hit = casefold_contains(F.col(display), F.lit(needle.strip()))
    f = files.withColumn("_hit", hit)
    # Bounded groups (files of one month, months of one year): windows avoid
    # recomputing the file list for a group-and-join-back.
    f = f.withColumn("month_visible", F.bool_or("_hit").over(Window.partitionBy(year, month)))
    f = f.withColumn("year_visible", F.bool_or("month_visible").over(Window.partitionBy(year)))
    return f.select(*files.columns, (F.col("_hit") & F.col("month_visible")).alias("file_visible"),
                    "month_visible", "year_visible")


def nest_manifest(entries: DataFrame, key: str, header: Sequence[Column], entry_fields: Sequence[str]) -> DataFrame:
    """One manifest document per key: header fields + sorted ``files`` array, as JSON text."""
    agg = entries.groupBy(key).agg(
        *header, F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in entry_fields]))).alias("files"))
    doc = F.struct(*[F.col(c) for c in agg.columns])
    return agg.select(F.col(key), F.size("files").alias("n_files"),
                      F.to_json(doc, {"ignoreNullFields": "false"}).alias("manifest_json"))


def explode_manifest(docs: DataFrame, json_col: str | None, schema: str | None = None,
                     default_version: str = "0.0.0", struct_col: str | None = None,
                     carry: Sequence[str] = ()) -> DataFrame:
    """Explode manifests' ``files`` (a missing array is empty; a missing
    ``app_version`` takes the default).  Input is either JSON text
    (``json_col`` + ``schema``) or an already parsed struct (``struct_col``);
    columns in ``carry`` stay with their document."""
    if struct_col is not None:
        m = docs.select(*carry, F.col(struct_col).alias("m"))
    else:
        m = docs.select(*carry, F.from_json(F.col(json_col), schema).alias("m"))
    cols = [F.col(f"m.{c}") for c in m.select("m.*").columns if c not in ("files", "app_version")]
    return m.select(*carry, *cols, F.coalesce(F.col("m.app_version"), F.lit(default_version)).alias("app_version"),
                    F.posexplode_outer(F.coalesce(F.col("m.files"), F.array())).alias("pos", "f")) \
        .select("*", "f.*").drop("f")


def manifest_upsert(files_col: str, entry: Column, code_field: str = "target_code") -> Column:
    """Replace the first entry with the same code in place, or append the entry."""
    fc = F.col(files_col)
    code = entry[code_field]
    pos = F.array_position(F.transform(fc, lambda x: x[code_field]), code)  # 1-based, 0 if absent
    return F.when(pos > 0, F.transform(fc, lambda x, i: F.when(i == pos - 1, entry).otherwise(x))) \
        .otherwise(F.concat(fc, F.array(entry)))


def manifest_remove(files_col, code: Column, code_field: str = "target_code") -> Column:
    fc = F.col(files_col) if isinstance(files_col, str) else files_col
    return F.filter(fc, lambda x: ~(x[code_field] == code))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all of frames with the same column names (order may differ)."""
    if not frames:
        raise ValueError("no frames to merge")
    names = sorted(frames[0].columns)
    for f in frames[1:]:
        if sorted(f.columns) != names:
            raise ValueError(f"header mismatch: {f.columns} vs {frames[0].columns}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_positional(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by position, names from the first non-empty frame.

    Zero-row frames are skipped (checked with a one-row probe each); every
    other frame must have the same arity; no non-empty frame is an error.
    """
    non_empty = [f for f in frames if not f.isEmpty()]
    if not non_empty:
        raise ValueError("no non-empty frame to merge")
    first = non_empty[0]
    width = len(first.columns)
    out = first
    for f in non_empty[1:]:
        if len(f.columns) != width:
            raise ValueError(f"column count {len(f.columns)} differs from {width}")
        out = out.union(f.toDF(*first.columns))
    return out


#: An anchor with a quoted href (groups 1 or 2) and its content (3), markup inside included.
ANCHOR_PATTERN = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a\s*>"""


def first_links(pages: DataFrame, html: str, key_pattern: str, page_key: str = "page_id") -> DataFrame:
    """Links whose href carries a key: first occurrence per (page, key) wins.

    Anchors are found with ``regexp_extract_all`` + ``posexplode`` (document
    order); the first-wins rule is a partial-aggregated ``min_by``.  Blank
    anchor text falls back to the key.
    """
    anchor = ANCHOR_PATTERN
    a = pages.select(page_key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(anchor), 0)).alias("pos", "a"))
    a = a.select(page_key, "pos",
                 F.concat(F.regexp_extract("a", anchor, 1), F.regexp_extract("a", anchor, 2)).alias("href"),
                 F.regexp_replace(F.regexp_extract("a", anchor, 3), "<[^>]*>", "").alias("text"))
    a = a.withColumn("link_key", F.lower(F.regexp_extract("href", key_pattern, 1))).filter(F.col("link_key") != "")
    first = a.groupBy(page_key, "link_key").agg(F.min_by(F.struct("href", "text"), F.col("pos")).alias("l"),
                                                 F.min("pos").alias("pos"))
    return first.select(page_key, "link_key", "pos", F.col("l.href").alias("url"),
                        F.coalesce(F.nullif(F.trim(F.col("l.text")), F.lit("")), F.col("link_key")).alias("link_text"))


#: Lengths of the pieces by which names are brought together; a name shorter than SHORT is its own piece.
PIECES = (0, 1, 2, 3, 6, 12, 24)
SHORT = 3


def _pieces(name: Column, lengths: tuple[int, ...]) -> Column:
    """Distinct pieces of ``name`` of the given lengths."""
    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(name) - n + 1)
        return F.when(F.length(name) >= n, F.transform(places, lambda i: F.substring(name, i, F.lit(n)))).otherwise(
            F.expr("cast(array() as array<string>)"))

    return F.array_distinct(F.flatten(F.array(*map(of, lengths))))


def candidates(inner: DataFrame, outer: DataFrame, part: str, whole: str) -> DataFrame:
    """Pairs of rows of which ``whole`` holds the rarest piece of ``part``.

    A name contains another only if it has all of its pieces.  How many names
    of ``outer`` have a piece is counted first, and each part goes by the
    piece that the fewest have (a part with a piece that none has goes
    nowhere); so a beginning that all names share brings nothing together.
    """
    held = outer.withColumn("_piece", F.explode(_pieces(F.col(whole), PIECES)))
    counts = held.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length(part) < SHORT, F.array(part)).otherwise(_pieces(F.col(part), tuple(n for n in PIECES if n >= SHORT)))
    rarity = F.struct(F.coalesce("_n", F.lit(0)), -F.length("_piece"), F.col("_piece"))
    rarest = (
        inner.select(part).distinct().withColumn("_piece", F.explode(own)).join(counts, "_piece", "left")
        .groupBy(part).agg(F.min(rarity).alias("_r")).where("_r.col1 > 0").select(part, F.col("_r._piece").alias("_piece"))
    )
    return inner.join(rarest, part).join(held, "_piece").drop("_piece")


def _contained(inner: DataFrame, outer: DataFrame, part: str, whole: str) -> DataFrame:
    """Pairs where ``whole`` contains ``part``."""
    return candidates(inner, outer, part, whole).filter(F.contains(F.col(whole), F.col(part)))


def match_links(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Link each target to a scraped link: exact key first, else containment.

    Exact: equal ``filename_key`` (the last link wins on a duplicate key).
    Otherwise the first link (by ``pos``) whose display name contains the
    target's, or is contained in it; candidates meet by equi joins on the
    rarest piece of the contained name.  ``pos`` may be a struct, ordered field by field.
    """
    exact = links.groupBy(F.col("filename_key").alias("_k")).agg(
        F.max_by(F.col("filename_key"), F.col("pos")).alias("_exact_key"))
    t = targets.join(exact, targets.filename_key == exact._k, "left").drop("_k")
    unmatched = t.filter(F.col("_exact_key").isNull()).select("code", F.col("display_name").alias("_tname"))
    lk = (links.groupBy(F.col("display_name").alias("_lname"))
          .agg(F.min_by("filename_key", "pos").alias("_lkey"), F.min("pos").alias("_lpos")))
    pairs = _contained(lk, unmatched, "_lname", "_tname").unionByName(_contained(unmatched, lk, "_tname", "_lname"))
    fuzzy = (pairs.groupBy("code").agg(F.min_by(F.col("_lkey"), F.col("_lpos")).alias("_fuzzy_key")))
    out = t.join(fuzzy, "code", "left")
    kind = (F.when(F.col("_exact_key").isNotNull(), F.lit("exact"))
            .when(F.col("_fuzzy_key").isNotNull(), F.lit("contains")).otherwise(F.lit("none")))
    return out.select(*[c for c in targets.columns if c != "filename_key"],
                      F.coalesce("_exact_key", "_fuzzy_key", "filename_key").alias("filename_key"),
                      kind.alias("match_kind"))
