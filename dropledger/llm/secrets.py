"""Secret scans: base patterns and sliding-window entropy, by SQL functions only.

Base kinds are regular expressions over the whole text (leftmost,
non-overlapping, failing matches dropped).  The method adds ``entropy`` spans:
a candidate is a run of 20 or more token characters with a digit.  A window of
20 characters slides over it; the counts of its characters, those of capitals,
small letters, digits, separators and hex letters, and the sum of c log2 c are
carried along, each step adding the entering and taking off the leaving
character.  The counts give each window a class of its own (hex; capitals and
digits, with separators or not; small letters and at least three digits;
letters of both cases and digits), and the class the least entropy, so a token
behind a prefix or a path is judged by itself.  The sum is held in whole
millionths of a bit, so results don't depend on rounding.  Hit windows that
touch are merged into one span; spans that a base span already covers are not
reported.  Windows of letters alone (prose), digits alone, or small letters
and digits with separators (slugs) have no class.

Allow-list: a part of a candidate between separators that holds one of the
words of ``ALLOW`` is an example, and no window that touches it counts; the
rest of the candidate is judged as ever.  UUIDs aren't candidates.

Positions are code points, end exclusive: the pieces between matches
(``split``) and the matches (``regexp_extract_all``) add up to them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import read_table, text_or_empty

#: The contract's patterns (fixed values).
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails as a whole, so the least lengths may stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: The token characters: capitals, small letters, digits, separators.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Class of a window: (condition on its numbers of capitals u, small letters l, digits d, separators s and hex letters h,
#: least bits per character).  The first that holds counts.
CLASSES = {
    "hex": ("s = 0 and d > 0 and h > 0 and u + l = h", 2.9),
    "mixed": ("d > 0 and l > 0 and u > 0", 3.65),
    "upper": ("d > 0 and u > 0 and l = 0 and s = 0", 3.45),
    "upper_apart": ("d > 0 and u > 0 and l = 0", 3.6),
    "lower": ("d >= 3 and l > 0 and u = 0 and s = 0", 3.6),
}
#: What looks random but isn't secret: parts of a candidate with one of these words, and UUIDs.
ALLOW = "(?i)example|sample|dummy|changeme|placeholder|xxxx|0123456789|abcdefghij"
UUID = "(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
SEPARATOR = "[+/_-]"
#: Matches whose places are added up in one list; the lists are joined once, so many matches take no copies of copies.
LIST = 256

_SPANS = "array<struct<start:int,stop:int,hit:string>>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(matches: str, pattern: str) -> str:
    """SQL: (start, stop, hit) of the matches of ``pattern`` in column ``_t``; ``matches`` names their strings."""
    pairs = f"""zip_with(split(_t, {_quoted(pattern)}, -1), {matches},
                 (gap, hit) -> named_struct('gap', char_length(gap), 'hit', coalesce(hit, '')))"""
    return f"""
      if(size({matches}) = 0, cast(array() as {_SPANS}), element_at(transform(array({pairs}), p -> flatten(aggregate(
        sequence(1, size(p), {LIST}),
        named_struct('at', 0, 'lists', cast(array() as array<{_SPANS}>)),
        (done, low) -> aggregate(
          array(aggregate(
            slice(p, low, {LIST}),
            named_struct('at', done.at, 'found', cast(array() as {_SPANS})),
            (acc, x) -> named_struct(
              'at', acc.at + x.gap + char_length(x.hit),
              'found', if(x.hit = '', acc.found, concat(acc.found, array(named_struct(
                  'start', acc.at + x.gap, 'stop', acc.at + x.gap + char_length(x.hit), 'hit', x.hit))))))),
          done,
          (d, part) -> named_struct('at', part.at, 'lists', concat(d.lists, array(part.found)))),
        done -> done.lists))), 1))"""


def _grain(count: int) -> int:
    """c log2 c in millionths."""
    return round(1e6 * count * math.log2(count)) if count else 0


def class_limits(window: int = WINDOW) -> dict[str, int]:
    """Greatest sum of c log2 c (millionths) that still has the class's least entropy."""
    return {k: math.floor(1e6 * window * (math.log2(window) - bits)) for k, (_, bits) in CLASSES.items()}


def _windows(candidate: str, allow: str) -> str:
    """SQL: merged hit windows of one candidate (a struct like those of ``_located``) as (start, stop)."""
    grains = f"array({', '.join(str(_grain(c)) for c in range(WINDOW + 1))})"  # by count
    whens = " ".join(f"when {cond} then {class_limits()[k]}" for k, (cond, _) in CLASSES.items())
    for name in "ulsdh":  # the conditions stand on the carried numbers
        whens = re.sub(rf"\b{name}\b", f"n.{name}", whens)
    examples = f"""aggregate(split({candidate}.hit, '{SEPARATOR}', -1),
        named_struct('at', 0, 'off', cast(array() as array<struct<start:int,stop:int>>)),
        (e, x) -> named_struct('at', e.at + char_length(x) + 1, 'off', if(x rlike {_quoted(allow)},
          concat(e.off, array(named_struct('start', e.at, 'stop', e.at + char_length(x)))), e.off)),
        e -> e.off)"""

    def grain(count: str) -> str:
        return f"get({grains}, {count})"

    def step(low: int, high: int) -> str:
        return f"if(x.enters between {low} and {high}, 1, 0) - if(x.leaves between {low} and {high}, 1, 0)"

    numbers = ("named_struct('u', acc.n.u + {}, 'l', acc.n.l + {}, 'd', acc.n.d + {}, 's', acc.n.s + {}, 'h', acc.n.h + {} + {})").format(
        step(1, 26), step(27, 52), step(53, 62), step(63, 66), step(1, 6), step(27, 32))
    # aggregate(array(x), a, (a, v) -> ...) binds v to x, which would be computed at each use else.
    return f"""
      flatten(transform(array({examples}), off ->
        flatten(transform(array(transform(split({candidate}.hit, ''), x -> instr('{ALPHABET}', x))), codes ->
          aggregate(
            zip_with(codes, concat(array_repeat(0, {WINDOW}), slice(codes, 1, size(codes) - {WINDOW})),
                     (enters, leaves) -> named_struct('enters', enters, 'leaves', leaves)),
            named_struct('counts', array_repeat(0, {len(ALPHABET)}), 'total', 0, 'at', 0,
                         'n', named_struct('u', 0, 'l', 0, 'd', 0, 's', 0, 'h', 0),
                         'start', -1, 'stop', -1, 'spans', cast(array() as array<struct<start:int,stop:int>>)),
            (acc, x) -> aggregate(
              array(named_struct('n', {numbers}, 'total', if(x.enters = x.leaves, acc.total, acc.total
                + {grain("get(acc.counts, x.enters - 1) + 1")} - {grain("get(acc.counts, x.enters - 1)")}
                + if(x.leaves = 0, 0,
                     {grain("get(acc.counts, x.leaves - 1) - 1")} - {grain("get(acc.counts, x.leaves - 1)")})))),
              acc,
              (a, v) -> aggregate(
                array(a.at + 1 >= {WINDOW} and v.total <= element_at(transform(array(v.n), n -> case {whens} else -1 end), 1)
                      and not exists(off, o -> o.start <= a.at and o.stop > a.at + 1 - {WINDOW})),
                a,
                (b, hot) -> named_struct(
                  'counts', if(x.enters = x.leaves, b.counts, transform(
                     b.counts, (c, i) -> c + if(i + 1 = x.enters, 1, 0) - if(i + 1 = x.leaves, 1, 0))),
                  'total', v.total,
                  'at', b.at + 1,
                  'n', v.n,
                  'start', if(hot and (b.start < 0 or b.at + 1 - {WINDOW} > b.stop), b.at + 1 - {WINDOW}, b.start),
                  'stop', if(hot, b.at + 1, b.stop),
                  'spans', if(hot and b.start >= 0 and b.at + 1 - {WINDOW} > b.stop,
                     concat(b.spans, array(named_struct('start', b.start, 'stop', b.stop))), b.spans)))),
            acc -> transform(
              if(acc.start < 0, acc.spans, concat(acc.spans, array(named_struct('start', acc.start, 'stop', acc.stop)))),
              s -> named_struct('start', {candidate}.start + s.start, 'stop', {candidate}.start + s.stop)))))))"""


def find_secrets(docs: DataFrame, text_col: str = "text", allow: str = ALLOW) -> DataFrame:
    """``docs`` with ``_spans``: array of (start, kind's rank, stop), sorted.

    A null text counts as empty and has no spans.  All rows and columns stay,
    whatever their names (a column ``_spans`` is replaced).
    """
    def kind(name: str, rank: int) -> str:
        return f"transform({name}, x -> named_struct('start', x.start, 'kind', {rank}, 'stop', x.stop))"

    names = [c for c in docs.columns if c != "_spans"]
    own = ["_own"]
    matched = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own"), text_or_empty(F.col(f"`{text_col}`")).alias("_t")).select(
        *own, "_t",
        F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(0)).alias("_assign"),
        F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)).alias("_access"),
        F.regexp_extract_all("_t", F.lit(HEX), F.lit(0)).alias("_hex"),
        F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0)).alias("_cand"))
    located = matched.select(
        *own,
        F.filter(F.expr(_located("_assign", ASSIGN)),
                 lambda x: F.length(F.regexp_extract(x.hit, ASSIGN, 2)) >= 8).alias("_assign"),
        F.expr(_located("_access", ACCESS)).alias("_access"),
        F.expr(_located("_hex", HEX)).alias("_hex"),
        F.filter(F.expr(_located("_cand", CANDIDATE)), lambda x: x.hit.rlike("[0-9]") & ~x.hit.rlike(UUID)).alias("_cand"))
    based = located.select(
        *own, F.expr(f"sort_array(concat({kind('_assign', 0)}, {kind('_access', 1)}, {kind('_hex', 2)}))").alias("_base"),
        F.expr(f"flatten(transform(_cand, c -> {_windows('c', allow)}))").alias("_hot"))
    fresh = ("transform(filter(_hot, x -> not exists(_base, b -> b.start <= x.start and x.stop <= b.stop)), "
             "x -> named_struct('start', x.start, 'kind', 3, 'stop', x.stop))")
    return based.select(
        *[F.col("_own").getField(c).alias(c) for c in names],
        F.expr(f"if(size(_hot) = 0, _base, sort_array(concat(_base, {fresh})))").alias("_spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", allow: str = ALLOW) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mark``; touching spans get one mark.

    Texts without a secret, null ones among them, stay as they are.
    """
    found = find_secrets(docs, text_col, allow)
    text = f"`{text_col}`"
    redacted = F.expr(f"""
      if(size(_spans) = 0, {text}, aggregate(
        _spans,
        named_struct('out', '', 'at', 0),
        (a, x) -> named_struct(
          'out', if(x.start < a.at, a.out, concat(a.out, substr({text}, a.at + 1, x.start - a.at), {_quoted(mark)})),
          'at', greatest(a.at, x.stop)),
        a -> concat(a.out, substr({text}, a.at + 1))))""")
    return found.withColumn(text_col, redacted).drop("_spans")


def _written(spans: str) -> str:
    names = f"array({', '.join(map(_quoted, KINDS))})"
    return f"array_join(transform({spans}, x -> concat(get({names}, x.kind), ':', x.start, ':', x.stop)), ',')"


def _sql_located(table: str, kind: str, pattern: str) -> str:
    """DuckDB: ``table`` has a row (doc_id, start, stop, hit) for each match of ``pattern``."""
    return f"""{table} AS (
  SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
      'start': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT),
      'hit': hits[i]}})) AS m, '{kind}' AS kind
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern.replace("'", "''")}', 0) AS hits,
               string_split_regex(text, '{pattern.replace("'", "''")}') AS gaps FROM docs))"""


#: RE2 folds some non-ASCII letters under (?i), so the cases stand in sets here.
_SQL_ASSIGN = ("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in (
    "password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS text FROM documents),
{_sql_located("assign_hits", "assign", _SQL_ASSIGN)},
{_sql_located("access_hits", "access", ACCESS)},
{_sql_located("hex_hits", "hex", HEX)},
{_sql_located("candidates", "entropy", CANDIDATE)},
base AS (
  SELECT doc_id, m.start AS start, m.start + length(m.hit) AS stop, kind, 0 AS rank FROM assign_hits
  WHERE length(regexp_extract(m.hit, '{_SQL_ASSIGN.replace("'", "''")}', 2)) >= 8
  UNION ALL SELECT doc_id, m.start, m.start + length(m.hit), kind, 1 FROM access_hits
  UNION ALL SELECT doc_id, m.start, m.start + length(m.hit), kind, 2 FROM hex_hits),
marked AS (
  SELECT doc_id, m.start AS start, m.hit AS hit, string_split_regex(m.hit, '{SEPARATOR}') AS parts FROM candidates
  WHERE regexp_matches(m.hit, '[0-9]') AND NOT regexp_matches(m.hit, '{UUID}')),
allowed AS (
  SELECT doc_id, start, hit, list_filter(list_transform(range(1, len(parts) + 1), lambda i: {{
      'lo': CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))), 0) + i - 1 AS BIGINT), 'part': parts[i]}}),
      lambda o: regexp_matches(o.part, '{ALLOW}')) AS off FROM marked),
windows AS (
  SELECT doc_id, start, i, off, substr(hit, i + 1, {WINDOW}) AS w
  FROM (SELECT doc_id, start, hit, off, unnest(range(0, length(hit) - {WINDOW} + 1)) AS i FROM allowed)),
counted AS (
  SELECT doc_id, start, i, w, off, length(regexp_replace(w, '[^A-Z]', '', 'g')) AS u, length(regexp_replace(w, '[^a-z]', '', 'g')) AS l,
         length(regexp_replace(w, '[^0-9]', '', 'g')) AS d, length(regexp_replace(w, '[A-Za-z0-9]', '', 'g')) AS s,
         length(regexp_replace(w, '[^a-fA-F]', '', 'g')) AS h FROM windows),
classed AS (
  SELECT *, CASE {" ".join(f"WHEN {cond} THEN {class_limits()[k]}" for k, (cond, _) in CLASSES.items())} ELSE -1 END AS most FROM counted),
hot AS (
  SELECT doc_id, start, list(CAST(i AS BIGINT) ORDER BY i) AS wins FROM classed
  WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c:
      CAST(round(1e6 * ({WINDOW} - length(replace(w, c, ''))) * log2({WINDOW} - length(replace(w, c, '')))) AS BIGINT))) <= most
    AND len(list_filter(off, lambda o: o.lo < i + {WINDOW} AND o.lo + length(o.part) > i)) = 0
  GROUP BY doc_id, start),
runs AS (
  SELECT doc_id, start, list_filter(wins, lambda x, i: i = 1 OR x > wins[i - 1] + {WINDOW}) AS begins,
         list_filter(wins, lambda x, i: i = len(wins) OR wins[i + 1] > x + {WINDOW}) AS finals
  FROM hot WHERE len(wins) > 0),
fresh AS (
  SELECT doc_id, start + unnest(begins) AS start, start + unnest(finals) + {WINDOW} AS stop FROM runs),
spans AS (
  SELECT doc_id, start, stop, kind, rank FROM base
  UNION ALL SELECT doc_id, start, stop, 'entropy', 3 FROM fresh f
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start <= f.start AND f.stop <= b.stop)),
told AS (
  SELECT doc_id, count_if(rank = 0) AS n_assign, count_if(rank = 1) AS n_access, count_if(rank = 2) AS n_hex,
         count_if(rank = 3) AS n_entropy,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base
  FROM spans GROUP BY doc_id)
SELECT d.id AS doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, CAST(coalesce(n_entropy, 0) AS BIGINT) AS n_entropy
FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id
"""


@query("op2_secret_scans", SQL)
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents: counts, digest of the base spans, all spans."""
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(rank: int) -> Column:
        return F.size(F.filter("_spans", lambda x: x.kind == rank)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_written("filter(_spans, x -> x.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_written("_spans")).alias("spans"), count(3).alias("n_entropy"))
