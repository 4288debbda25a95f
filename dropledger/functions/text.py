"""Scalar label, key and matching expressions (all JVM-side).

Rounding: byte sizes are divided as decimals and rounded half-to-even
(``bround``) before being rendered, which reproduces the reference's
correctly rounded ``%.1f``/``%.2f`` of binary fractions.  A printf-style
format would round exact halves up instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit thresholds and label texts.
KIB, MIB, GIB = 1024, 1024 * 1024, 1024 * 1024 * 1024
PLACEHOLDER = "—"
ROWS_SUFFIX = "行"
YEAR_SUFFIX = "年"
MONTH_SUFFIX = "月分"
USAGE_WORD = "使用"
LINK_KEY_PATTERN = r"(?i)typeB_([A-Za-z0-9_]+)\.zip"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ratio(n, d: int, places: int) -> Column:
    """``n / d`` rounded half-to-even at ``places`` decimals, as a decimal."""
    q = _c(n).cast("decimal(20,0)") / F.lit(d).cast("decimal(20,0)")
    return F.bround(q, places).cast(f"decimal(24,{places})")


def format_bytes(size) -> Column:
    """``B`` below 1 KiB, then KB / MB with one decimal, GB with two."""
    s = _c(size)
    return (F.when(s < KIB, F.concat(s.cast("string"), F.lit(" B")))
            .when(s < MIB, F.concat(_ratio(s, KIB, 1).cast("string"), F.lit(" KB")))
            .when(s < GIB, F.concat(_ratio(s, MIB, 1).cast("string"), F.lit(" MB")))
            .otherwise(F.concat(_ratio(s, GIB, 2).cast("string"), F.lit(" GB"))))


def thousands(n) -> Column:
    """Integer with ``,`` thousands separators."""
    return F.format_number(_c(n).cast("long"), 0)


def file_label(display_name, file_size, row_count) -> Column:
    """``name  12,345行  1.50GB``; an unknown row count shows ``—行``."""
    rows = F.coalesce(F.concat(thousands(row_count), F.lit(ROWS_SUFFIX)), F.lit(PLACEHOLDER + ROWS_SUFFIX))
    return F.concat(_c(display_name), F.lit("  "), rows, F.lit("  "),
                    _ratio(file_size, GIB, 2).cast("string"), F.lit("GB"))


def year_label(year) -> Column:
    return F.concat(_c(year).cast("string"), F.lit(YEAR_SUFFIX))


def month_label(year, month, folder_name, status=None) -> Column:
    """``2026年3月分 (2026_3)`` plus `` [status]`` when a status is known."""
    base = F.concat(_c(year).cast("string"), F.lit(YEAR_SUFFIX), _c(month).cast("string"),
                    F.lit(MONTH_SUFFIX), F.lit(" ("), _c(folder_name), F.lit(")"))
    if status is None:
        return base
    st = _c(status)
    return F.when((st.isNotNull()) & (st != ""), F.concat(base, F.lit(" ["), st, F.lit("]"))).otherwise(base)


def export_name(publish_ym, suffix, stamp_ts, prefix: str = "export") -> Column:
    """``<prefix>_<ym>_<YYYYmmdd_HHMMSS>.<suffix>`` for an export file."""
    return F.concat(F.lit(prefix + "_"), _c(publish_ym), F.lit("_"),
                    F.date_format(_c(stamp_ts), "yyyyMMdd_HHmmss"), F.lit("."), _c(suffix))


# Fixed value: usage label when the library root or its volume is unavailable.
USAGE_UNKNOWN = "— / —（—% 使用）"


def usage_label(library_bytes, capacity_bytes) -> Column:
    """``a GB / b GB（p% 使用）``; percent is 0 for a zero capacity; unknown
    sizes (NULL: no root, unreadable volume) give the placeholder label."""
    lib, cap = _c(library_bytes), _c(capacity_bytes)
    pct = F.when(cap == 0, F.lit(0).cast("decimal(24,1)")).otherwise(
        F.bround(lib.cast("decimal(20,0)") * F.lit(100).cast("decimal(20,0)") / cap.cast("decimal(20,0)"), 1)
        .cast("decimal(24,1)"))
    label = F.concat(_ratio(lib, GIB, 2).cast("string"), F.lit(" GB / "),
                     _ratio(cap, GIB, 2).cast("string"), F.lit(" GB（"),
                     pct.cast("string"), F.lit("% "), F.lit(USAGE_WORD), F.lit("）"))
    return F.coalesce(label, F.lit(USAGE_UNKNOWN))


def scope_key(publish_ym, target_code, file_name) -> Column:
    """``ym/code`` for a file, falling back to the file name when the code is empty."""
    return F.concat(_c(publish_ym), F.lit("/"), F.coalesce(F.nullif(_c(target_code), F.lit("")), _c(file_name)))


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def link_key(url, pattern: str = LINK_KEY_PATTERN) -> Column:
    """Lower-cased key captured from a link URL ('' when it does not match)."""
    return F.lower(F.regexp_extract(_c(url), pattern, 1))


def contains_either(a, b) -> Column:
    """Bidirectional containment."""
    return F.contains(_c(a), _c(b)) | F.contains(_c(b), _c(a))


def casefold_contains(haystack, needle) -> Column:
    """``needle`` (trimmed) inside ``haystack``, both lower-cased.

    Spark's ``lower`` is not Python's ``casefold`` (ß, ligatures); Japanese
    names are unaffected.
    """
    trimmed = F.regexp_replace(_c(needle), r"(?U)^\s+|\s+$", "")  # full-width blanks too
    return F.contains(F.lower(_c(haystack)), F.lower(trimmed))


def jst_iso(ts) -> Column:
    """ISO-8601 seconds text with the +09:00 offset of a UTC wall-clock timestamp."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), _c(ts).cast("timestamp_ntz"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def now_jst_iso() -> Column:
    """Current time as JST ISO-8601 seconds text (source zone: the session's)."""
    return F.concat(F.date_format(F.convert_timezone(None, F.lit("Asia/Tokyo"), F.current_timestamp()),
                                  "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def cache_key(path, size, mtime) -> Column:
    """Composite key as a JSON array text ``[path, size, mtime]``."""
    return F.to_json(F.array(_c(path), _c(size).cast("string"), _c(mtime).cast("string")))
