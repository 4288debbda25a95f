"""Links of stored pages as a browser's document shows them.

Comments, scripts and the like hide what they hold, attributes may be quoted
or not, an anchor that isn't closed ends where the next one begins, entities
stand for characters, and addresses are relative to the page's.  Everything is
column expressions; a page's links are counted where its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose content is text, not markup, and the named entities that are decoded.
RAW_ELEMENTS = ["script", "style", "textarea", "title", "template", "iframe", "noembed", "noframes", "xmp"]
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}

OPENS, INSIDE, CLOSES = "\x01", "\x02", "\x03"  # stand for an anchor's beginning, the end of its attributes, its end
CONTROLS = r"[\x01-\x03]"


def _attributes(possessive: str) -> str:
    return rf"""(?:[^>"']+{possessive}|"[^"]*"|'[^']*')*{possessive}"""


def markup_pattern(possessive: str = "+") -> str:
    """What a page holds beside text; group 1 is an anchor's tag.  Regex engines without backtracking take ``possessive=""``."""
    attrs = _attributes(possessive)
    hidden = "|".join(rf"<{e}(?:[\s/]{attrs})?>.*?(?:</{e}(?:[\s/][^>]*)?>|\z)" for e in RAW_ELEMENTS)
    return rf"(?is)<!--.*?(?:-->|\z)|{hidden}|<[!?][^>]*>|(<a(?:[\s/]{attrs})?>|</a(?:[\s/][^>]*)?>)|</?[a-z]{attrs}>"


def open_pattern(possessive: str = "+") -> str:
    return rf"(?is)<a((?:[\s/]{_attributes(possessive)})?)>"


CLOSE_PATTERN = r"(?is)</a(?:[\s/][^>]*)?>"
ANCHOR = r"\x01([^\x01\x02]*)\x02([^\x01\x03]*)"
ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?"""
HREF = r"(?is)^href\s*=\s*"
QUOTED = r"""(?s)^(?:"(.*)"|'(.*)')$"""
ENTITY_OR_TEXT = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[^&]+|&"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ORIGIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def decode_entities(text: Column) -> Column:
    """Numeric entities and the named ones above; a number that is no character becomes U+FFFD, other names stay."""
    def char(piece: Column) -> Column:
        hexa = piece.rlike("^&#[xX]")
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        known = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(piece.rlike("^&#[0-9xX]"), known).otherwise(piece)

    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY_OR_TEXT), 0), char), "")).otherwise(text)
    for name, value in ENTITIES.items():  # the ampersand last, so that nothing is decoded twice
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def _without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` parts."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(tail, "/"))).otherwise(path)


def resolve(href: Column, base: Column) -> Column:
    """``href`` as an address, relative to ``base`` (the page's own; a ``<base>`` element isn't regarded)."""
    origin = F.regexp_extract(base, ORIGIN, 0)
    path = F.regexp_extract(base, ORIGIN + r"([^?#]*)", 1)
    page = F.regexp_replace(base, "#.*$", "")
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/"))
    rest = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(href, "^[^?#]*", 0)
    return (F.when(href == "", page)
            .when(href.rlike(ABSOLUTE), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, ABSOLUTE, 0), href))
            .when(href.startswith("/"), F.concat(origin, _without_dots(own), rest))
            .when(href.startswith("?"), F.concat(origin, path, href))
            .when(href.startswith("#"), F.concat(page, href))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), rest)))


def anchors(html: Column) -> Column:
    """Array of (attrs, content) of a page's anchors, in order; content is text without tags, white space as it stands."""
    plain = F.regexp_replace(F.regexp_replace(html, CONTROLS, ""), markup_pattern(), "$1")
    marked = F.regexp_replace(F.regexp_replace(plain, open_pattern(), f"{OPENS}$1{INSIDE}"), CLOSE_PATTERN, CLOSES)
    return F.arrays_zip(F.regexp_extract_all(marked, F.lit(ANCHOR), 1).alias("attrs"),
                        F.regexp_extract_all(marked, F.lit(ANCHOR), 2).alias("content"))


def document_links(pages: DataFrame, html: str, key_pattern: str, page_key: str = "page_id", url: str | None = None) -> DataFrame:
    """Links whose address carries a key (group 1 of ``key_pattern``): the first for each (page, key) wins.

    Returns (page key, link_key in lower case, pos among the page's anchors,
    url, link_text with white space joined, or the key if it is blank).  Of
    repeated ``href`` attributes the first counts; an anchor without one is no
    link.  With ``url`` addresses are resolved against that column.  A null or
    empty page has no links.  First wins by a partial aggregate.
    """
    a = pages.select(F.col(page_key), F.col(url).alias("_base") if url else F.lit(None).cast("string").alias("_base"),
                     F.posexplode(anchors(F.col(html))).alias("pos", "_a"))
    tokens = F.regexp_extract_all(F.col("_a.attrs"), F.lit(ATTRIBUTE), 0)
    a = a.withColumn("_token", F.try_element_at(F.filter(tokens, lambda x: x.rlike(HREF)), F.lit(1)))
    bare = F.regexp_replace(F.regexp_replace("_token", HREF, ""), QUOTED, "$1$2")
    a = a.where("_token is not null").withColumn("_href", F.trim(decode_entities(bare)))
    a = a.withColumn("url", resolve(F.col("_href"), F.col("_base")) if url else F.col("_href"))
    text = F.trim(F.regexp_replace(decode_entities(F.col("_a.content")), r"\s+", " "))
    a = a.select(page_key, "pos", "url", text.alias("_text"), F.lower(F.regexp_extract("url", key_pattern, 1)).alias("link_key"))
    first = a.where("link_key <> ''").groupBy(page_key, "link_key").agg(F.min_by(F.struct("pos", "url", "_text"), "pos").alias("_l"))
    return first.select(page_key, "link_key", "_l.pos", "_l.url",
                        F.coalesce(F.nullif(F.col("_l._text"), F.lit("")), F.col("link_key")).alias("link_text"))
