"""Month-key calendar arithmetic as Spark column expressions.

A data month is keyed ``YYYY_M`` (month not zero padded); the publication
month trails it by a fixed lag.  Everything here is a JVM-side expression,
so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules.
MONTH_KEY_PATTERN = r"^(\d{4})_(\d{1,2})$"
PUBLISH_LAG_MONTHS = 2
DATA_BASE_URL = "https://www.jartic.or.jp"
DATA_ROOT_URL = DATA_BASE_URL + "/d/opendata/"
DATA_DIR_TEMPLATE = DATA_ROOT_URL + "{compact}/"
ZIP_NAME_TEMPLATE = "typeB_{key}.zip"
DOC_FILE_NAME = "typeB_danmen.pdf"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_key(year, month) -> Column:
    """``YYYY_M`` key from integer year and month columns (no padding)."""
    return F.concat_ws("_", _c(year).cast("string"), _c(month).cast("string"))


def month_key_of(date_col) -> Column:
    """Data-month key of a date/timestamp column."""
    d = _c(date_col)
    return month_key(F.year(d), F.month(d))


def parse_month_key(key) -> Column:
    """Parse a ``YYYY_M`` key into ``struct(year int, month int)``.

    Invalid keys (bad form, or month outside 1..12) give NULL fields, so the
    caller can keep or reject them; ``strict_month_key`` raises instead.
    """
    k = _c(key)
    # A non-matching key extracts '' for both groups, which try_cast turns into NULL.
    m = F.regexp_extract(k, MONTH_KEY_PATTERN, 2).try_cast("int")
    valid = F.coalesce(m.between(1, 12), F.lit(False))
    return F.struct(
        F.when(valid, F.regexp_extract(k, MONTH_KEY_PATTERN, 1).try_cast("int")).alias("year"),
        F.when(valid, m).alias("month"),
    )


def strict_month_key(key) -> Column:
    """Like :func:`parse_month_key` but fails the query on an invalid key."""
    k = _c(key)
    parsed = parse_month_key(k)
    return F.when(parsed["month"].isNull(),
                  F.raise_error(F.concat(F.lit("Invalid folder name: "), k))
                  ).otherwise(parsed)


def shift_month(year, month, delta) -> Column:
    """``struct(year, month)`` shifted by ``delta`` months (may be negative)."""
    d = F.add_months(F.make_date(_c(year), _c(month), F.lit(1)), _c(delta) if not isinstance(delta, int) else F.lit(delta))
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"))


def compact_publish_key(year, month) -> Column:
    """``YYYYMM010000`` for a publication month."""
    return F.concat(_c(year).cast("string"), F.lpad(_c(month).cast("string"), 2, "0"), F.lit("010000"))


def dir_url(compact) -> Column:
    pre, post = DATA_DIR_TEMPLATE.split("{compact}")
    return F.concat(F.lit(pre), _c(compact), F.lit(post))


def zip_url(compact, filename_key) -> Column:
    pre, post = ZIP_NAME_TEMPLATE.split("{key}")
    return F.concat(dir_url(compact), F.lit(pre), _c(filename_key), F.lit(post))


def doc_url(compact) -> Column:
    return F.concat(dir_url(compact), F.lit(DOC_FILE_NAME))


def publish_info_from_today(today) -> Column:
    """Publication info for a calendar day: the data month is ``today - lag``."""
    t = _c(today)
    data = F.add_months(F.trunc(t, "month"), -PUBLISH_LAG_MONTHS)
    compact = compact_publish_key(F.year(t), F.month(t))
    return F.struct(
        F.year(t).alias("publish_year"),
        F.month(t).alias("publish_month"),
        F.year(data).alias("data_year"),
        F.month(data).alias("data_month"),
        month_key(F.year(data), F.month(data)).alias("folder_name"),
        compact.alias("publish_ym_compact"),
        dir_url(compact).alias("dir_url"),
    )


def publish_info_from_key(key) -> Column:
    """Publication info for a ``YYYY_M`` data-month key (key + lag)."""
    p = parse_month_key(key)
    pub = F.add_months(F.make_date(p["year"], p["month"], F.lit(1)), PUBLISH_LAG_MONTHS)
    compact = compact_publish_key(F.year(pub), F.month(pub))
    return F.struct(
        F.year(pub).alias("publish_year"),
        F.month(pub).alias("publish_month"),
        p["year"].alias("data_year"),
        p["month"].alias("data_month"),
        _c(key).alias("folder_name"),
        compact.alias("publish_ym_compact"),
        dir_url(compact).alias("dir_url"),
    )


def publication_date(publish_year, publish_month) -> Column:
    """ISO date string of the first day of the publication month."""
    return F.date_format(F.make_date(_c(publish_year), _c(publish_month), F.lit(1)), "yyyy-MM-dd")
