"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

For every text: words, characters, symbols, repeated lines and words in
repeated three-word windows.  Documents that pass the base rule get a vector
of four transformed statistics (logarithms of mean word length and of one plus
symbols per word, repeated lines per line and repeated words per word), held
as whole thousandths, so that sums are exact and no result depends on the
order of rows.

Per language and source the estimate is that of the half of the documents
(n + p + 1 over 2 of n, for p statistics) whose covariance has the least
determinant, so up to nearly half of a group may be junk.  There are three
starts: the medians with the scale floors, the medians with the median
deviations, and mean and covariance of the whole group.  A concentration step
takes the half with the least Mahalanobis distance from the estimate for the
next mean and covariance; a start goes on as long as that lowers its
determinant, and of the three the least wins.

Vectors are folded to the different ones with their counts.  One pass over
these makes a step of all starts: counts and sums by group and distance bin
are added up over the bins of the half, the needed share of the last bin
included, so the data meet only in sums of bounded size and a hot source needs
no care.  The covariance gets the usual consistency factor for half of normal
data, and the scale floors on its diagonal: a group in which a statistic
(nearly) never varies, and a group of few documents, is judged by the floors.
These are low enough that each statistic can reject a document alone that the
base rule lets pass.  Distances come from a Cholesky factor written out as
column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import BLANKS, materialise, read_table, text_or_empty

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Share of a group's documents that the core has in the limit, for the consistency factor.
CORE = 0.5
#: Concentration steps of a start at most (few take more than five).
STEPS = 10
#: A step counts if it lowers the determinant by more than this share.
GAIN = 1e-9
#: Median absolute deviation to standard deviation of normal data.
SPREAD = 1.4826
#: The least standard deviations that count as real, in thousandths: mean word length, symbols, lines, words.
FLOORS = (50, 50, 80, 60)
#: Squared distances above this quantile of the chi-square distribution are outliers.
QUANTILE = 0.9999
#: Distance bins for each factor e of 1 + d^2.
BINS = 32
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
STATISTICS = ("_n_words", "_word_chars", "_n_symbols", "_n_lines", "_n_dup_lines", "_n_repeat_words")
RESULTS = (*STATISTICS, "_base_failed", "_d2", "_kept")


def chi_square_quantile(share: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(dof // 2))
        low, high = (mid, high) if 1 - tail < share else (low, mid)
    return high


def consistency(core: float) -> float:
    """Factor that makes the core's covariance that of normal data."""
    x = chi_square_quantile(core, P) / 2
    return core / (1 - math.exp(-x) * sum(x ** i / math.factorial(i) for i in range(P // 2 + 1)))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_words _word_chars _n_symbols _n_lines _n_dup_lines _n_repeat_words`` (long).

    Equal windows are recognised by 64-bit hashes within one text.  Columns
    with one of these names are replaced, all others kept.
    """
    names = [c for c in docs.columns if c not in STATISTICS]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own"), F.col(f"`{text_col}`").alias("_text"))
    own, text_col = [F.col("_own")], "_text"
    # Each array is a column of its own that is used more than once, so Spark computes it once for each row.
    split = docs.select(*own, text_or_empty(F.col(f"`{text_col}`")).alias("_t")).select(
        *own, "_t",
        F.filter(F.split("_t", WORD_GAP, -1), lambda x: x != "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "").alias("_l"))
    hashed = split.select(
        *own, "_t", "_w", "_l",
        F.expr("""if(size(_w) < 3, cast(array() as array<bigint>), transform(
            arrays_zip(slice(_w, 1, size(_w) - 2), slice(_w, 2, size(_w) - 2), slice(_w, 3, size(_w) - 2)),
            x -> xxhash64(x.`0`, x.`1`, x.`2`)))""").alias("_h"))
    # Windows in the order of hash and place: an equal neighbour is a repeat.
    ordered = hashed.select(
        *own, "_t", "_w", "_l",
        F.expr("""if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h:bigint,i:int>>),
            sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))))""").alias("_o"))
    repeated = ordered.select(
        *own, "_t", "_w", "_l",
        F.expr("""if(size(_o) < 2, cast(array() as array<int>), sort_array(array_distinct(flatten(zip_with(
            slice(_o, 1, size(_o) - 1), slice(_o, 2, size(_o) - 1),
            (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))))))""").alias("_r"))
    return repeated.select(
        *[F.col("_own").getField(c).alias(c) for c in names],
        F.size("_w").cast("long").alias("_n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("_word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("_n_symbols"),
        F.size("_l").cast("long").alias("_n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_n_dup_lines"),
        F.expr("""if(size(_r) = 0, 0L, aggregate(
            zip_with(_r, slice(_r, 2, size(_r)), (a, b) -> least(3, coalesce(b - a, 3))),
            0L, (n, x) -> n + x))""").alias("_n_repeat_words"))


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def _vector() -> list[Column]:
    words = F.col("_n_words").cast("double")
    values = (
        F.log(F.col("_word_chars") / words),
        F.log(1 + F.col("_n_symbols") / words),
        F.log(1 + F.col("_n_dup_lines") / F.col("_n_lines")),
        F.log(1 + F.col("_n_repeat_words") / words),
    )
    return [F.round(1000 * v).cast("long") for v in values]


def _distance(mean: list[Column], chol: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance of v0 … by forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(f"_v{i}") - mean[i]
        for j in range(i):
            rest = rest - chol[i, j] * z[j]
        z.append(rest / chol[i, i])
    return sum((x * x for x in z[1:]), z[0] * z[0])


KEYS = ["_lang", "_source"]
_MEANS = [f"m{i}" for i in range(P)]
_FACTOR = [f"c{i}{j}" for i, j in PAIRS]
_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i, j in PAIRS]


def _estimates(summed: DataFrame, factor: float) -> DataFrame:
    """Mean, Cholesky factor and determinant (m0 …, c00, c10 …, det) from core sums (n, o0 …, s0 …, s00 …) of each row."""
    n = F.col("n")
    mean = {i: F.col(f"s{i}") / n for i in range(P)}
    cov = {(i, j): (F.col(f"s{i}{j}") / n - mean[i] * mean[j]) * F.lit(factor)
           + (F.lit(float(FLOORS[i] ** 2)) if i == j else F.lit(0.0)) for i, j in PAIRS}
    out = summed.select(*KEYS, "start", *[(F.col(f"o{i}") + mean[i]).alias(f"m{i}") for i in range(P)],
                        *[c.alias(f"k{i}{j}") for (i, j), c in cov.items()])
    for j in range(P):  # a column of the factor after the other, each from those before
        diagonal = F.col(f"k{j}{j}")
        for k in range(j):
            diagonal = diagonal - F.col(f"c{j}{k}") * F.col(f"c{j}{k}")
        out = out.withColumn(f"c{j}{j}", F.sqrt(diagonal))
        for i in range(j + 1, P):
            below = F.col(f"k{i}{j}")
            for k in range(j):
                below = below - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            out = out.withColumn(f"c{i}{j}", below / F.col(f"c{j}{j}"))
    det = F.lit(1.0)
    for j in range(P):
        det = det * F.col(f"c{j}{j}") * F.col(f"c{j}{j}")
    return out.withColumn("det", det).drop(*[f"k{i}{j}" for (i, j) in cov])


def _factor() -> dict[tuple[int, int], Column]:
    return {(i, j): F.col(f"c{i}{j}") for i, j in PAIRS}


def _middle(values: DataFrame, value: str, out: str) -> DataFrame:
    """Weighted lower median of ``value`` by group as columns ``out``0 …, from rows (dim, value, n)."""
    run = Window.partitionBy(*KEYS, "dim").orderBy(value)
    return (
        values.groupBy(*KEYS, "dim", value).agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*KEYS, "dim")))
        .where("2 * upto >= all")
        .groupBy(*KEYS).agg(*[F.min(F.when(F.col("dim") == i, F.col(value))).alias(f"{out}{i}") for i in range(P)])
    )


def _starts(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Medians o0 … by group, and the three starts (start, m0 …, c00 …, det)."""
    values = folded.select(*KEYS, "n", F.posexplode(F.array(*[f"_v{i}" for i in range(P)])).alias("dim", "value"))
    # A row for each different thousandth of a statistic in a group: some thousand.
    values = materialise(values.groupBy(*KEYS, "dim", "value").agg(F.sum("n").alias("n")), "quality-values")
    origin = materialise(_middle(values, "value", "o"), "quality-medians")
    own = F.element_at(F.array(*[f"o{i}" for i in range(P)]), F.col("dim") + 1)
    spread = _middle(values.join(origin, KEYS).withColumn("away", F.abs(F.col("value") - own)), "away", "g")
    infinite = F.lit(float("inf")).alias("det")

    def plain(start: int, scale) -> DataFrame:
        return origin.join(spread, KEYS).select(
            *KEYS, F.lit(start).alias("start"), *[F.col(f"o{i}").cast("double").alias(f"m{i}") for i in range(P)],
            *[(scale(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS], infinite)

    whole = folded.join(origin, KEYS).groupBy(*KEYS, *[f"o{i}" for i in range(P)]).agg(*_sums())
    whole = whole.withColumn("start", F.lit(2)).select(
        *KEYS, "start", *[f"o{i}" for i in range(P)], *[F.col(c).cast("double").alias(c) for c in ["n", *_SUMS]])
    starts = plain(0, lambda i: F.lit(float(FLOORS[i]))).unionByName(
        plain(1, lambda i: F.sqrt(F.lit(float(FLOORS[i] ** 2)) + SPREAD * F.col(f"g{i}") * (SPREAD * F.col(f"g{i}"))))).unionByName(
        _estimates(whole, 1.0).withColumn("det", infinite))
    return origin, materialise(starts, "quality-starts")


def _sums() -> list[Column]:
    """Counts and sums of a group of folded vectors, from their medians."""
    u = [F.col(f"_v{i}") - F.col(f"o{i}") for i in range(P)]
    return [F.sum("n").alias("n"), *[F.sum(u[i] * F.col("n")).alias(f"s{i}") for i in range(P)],
            *[F.sum(u[i] * u[j] * F.col("n")).alias(f"s{i}{j}") for i, j in PAIRS]]


def _step(folded: DataFrame, origin: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates after a concentration step; a start whose determinant doesn't fall stays as it is (``moved``)."""
    group = [*KEYS, "start", *[f"o{i}" for i in range(P)]]
    far = folded.join(estimates.join(origin, KEYS), KEYS).withColumn("_d2", _distance([F.col(m) for m in _MEANS], _factor()))
    bins = far.withColumn("bin", F.floor(BINS * F.log(1 + F.col("_d2")))).groupBy(*group, "bin").agg(*_sums())
    by_bin = Window.partitionBy(*KEYS, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    half = F.expr(f"(all + {P + 1}) div 2")
    bins = (
        bins.withColumn("before", F.coalesce(F.sum("n").over(by_bin), F.lit(0)))
        .withColumn("all", F.sum("n").over(Window.partitionBy(*KEYS, "start"))).withColumn("half", half).where("before < half")
    )
    # Whole bins are summed exactly; of the last one the share that the half still needs.
    part = F.col("before") + F.col("n") > F.col("half")
    inner = bins.groupBy(*group).agg(
        F.max(F.when(part, (F.col("half") - F.col("before")) / F.col("n"))).alias("share"),
        *[F.coalesce(F.sum(F.when(~part, F.col(c))), F.lit(0)).alias(f"in_{c}") for c in ["n", *_SUMS]],
        *[F.coalesce(F.sum(F.when(part, F.col(c))), F.lit(0)).alias(f"at_{c}") for c in ["n", *_SUMS]])
    inner = inner.select(*group, *[
        (F.col(f"in_{c}").cast("double") + F.col(f"at_{c}") * F.coalesce("share", F.lit(0.0))).alias(c) for c in ["n", *_SUMS]])
    names = [*_MEANS, *_FACTOR, "det"]
    new = _estimates(inner, consistency(CORE)).select(*KEYS, "start", F.struct(*names).alias("new"))
    moved = F.col("new.det") < F.col("det") * (1 - GAIN)
    return estimates.drop("moved").join(new, [*KEYS, "start"]).select(
        *KEYS, "start", *[F.when(moved, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in names], moved.alias("moved"))


def mcd_estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """Robust mean and Cholesky factor of each (_lang, _source) of ``vectors`` (_v0 … as whole thousandths)."""
    folded = materialise(
        vectors.groupBy(*KEYS, *[f"_v{i}" for i in range(P)]).agg(F.count(F.lit(1)).alias("n")), "quality-folded")
    origin, estimates = _starts(folded)
    for step in range(steps):
        estimates = materialise(_step(folded, origin, estimates), f"quality-step-{step}")
        if estimates.where("moved").isEmpty():
            break
    names = [*_MEANS, *_FACTOR]
    return materialise(estimates.groupBy(*KEYS).agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("best")).select(
        *KEYS, *[F.col(f"best.{c}").alias(c) for c in names]), "quality-estimates")


def quality_vectors(docs: DataFrame) -> DataFrame:
    """``docs`` (_own, _text, _lang, _source) but for the text, with the statistics, _base_failed and, if that is false, _v0 …"""
    stats = text_statistics(docs, "_text")
    return stats.select(
        "_own", "_lang", "_source", *STATISTICS, base_failed().alias("_base_failed"),
        *[F.when(~base_failed(), v).alias(f"_v{i}") for i, v in enumerate(_vector())])


def _judged(docs: DataFrame, carry: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(_own, statistics, _base_failed, _d2, _kept): the columns ``carry`` are in the struct ``_own``."""
    vectors = materialise(quality_vectors(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_own"), F.col(f"`{text_col}`").alias("_text"),
        F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("_lang"),
        F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("_source"))), "quality-vectors")
    estimates = mcd_estimates(vectors.where("NOT _base_failed").select(*KEYS, *[f"_v{i}" for i in range(P)]))
    limit = chi_square_quantile(QUANTILE, P)
    return (
        vectors.join(estimates, KEYS, "left")
        .withColumn("_d2", F.when(~F.col("_base_failed"), _distance([F.col(m) for m in _MEANS], _factor())))
        .withColumn("_kept", F.coalesce(F.col("_d2") <= limit, F.lit(False))).select("_own", *RESULTS)
    )


def judge_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  carry: list[str] | None = None) -> DataFrame:
    """Statistics, ``_base_failed``, ``_d2`` and ``_kept`` of every row, with the columns ``carry`` (all if None).

    A null text counts as empty and fails the base rule; a null language or
    source forms a group of its own (with '').  Repeated rows and null ids
    stay; an empty table gives no rows.  Columns may have any name; one named
    like a result (``RESULTS``) is replaced.  What is carried is written once,
    with the vectors.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    return _judged(docs, carry, text_col, lang_col, source_col).select(
        *[F.col("_own").getField(c).alias(c) for c in carry], *RESULTS)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are, whatever their names."""
    return _judged(docs, docs.columns, text_col, lang_col, source_col).where("_kept").select(
        *[F.col("_own").getField(c).alias(c) for c in docs.columns])


# ---------------------------------------------------------------- SQL

def _sql_distance(vectors: str, estimates: str) -> str:
    """DuckDB: ``vectors`` joined to ``estimates``, with d2."""
    z = []
    for i in range(P):
        rest = f"v{i} - m{i}" + "".join(f" - c{i}{j} * z{j}" for j in range(i))
        z.append(f"({rest}) / c{i}{i} AS z{i}")
    square = " + ".join(f"z{i} * z{i}" for i in range(P))
    return f"SELECT *, {', '.join(z)}, {square} AS d2 FROM {vectors} JOIN {estimates} USING (lang, source)"


def _sql_estimates(out: str, source: str, factor: float) -> list[str]:
    """DuckDB: mean, Cholesky factor and determinant from core sums, as ``_estimates``."""
    cols = [f"s{i} / cnt AS a{i}" for i in range(P)]
    cols += [f"(s{i}{j} / cnt - a{i} * a{j}) * {factor!r}::DOUBLE + {float(FLOORS[i] ** 2) if i == j else 0.0}::DOUBLE AS k{i}{j}" for i, j in PAIRS]
    for j in range(P):
        cols.append(f"sqrt(k{j}{j}" + "".join(f" - c{j}{x} * c{j}{x}" for x in range(j)) + f") AS c{j}{j}")
        cols += [f"(k{i}{j}" + "".join(f" - c{i}{x} * c{j}{x}" for x in range(j)) + f") / c{j}{j} AS c{i}{j}" for i in range(j + 1, P)]
    cols += [f"o{i} + a{i} AS m{i}" for i in range(P)]
    cols.append("1.0::DOUBLE" + "".join(f" * c{j}{j} * c{j}{j}" for j in range(P)) + " AS det")
    return [f"{out}_all AS MATERIALIZED (SELECT lang, source, start, {', '.join(cols)} FROM {source})",
            f"{out} AS MATERIALIZED (SELECT lang, source, start, {', '.join([*_MEANS, *_FACTOR, 'det'])} FROM {out}_all)"]


def _sql() -> str:
    limit, factor = chi_square_quantile(QUANTILE, P), consistency(CORE)
    origins, names = ", ".join(f"o{i}" for i in range(P)), [*_MEANS, *_FACTOR, "det"]
    vs = ", ".join(f"v{i}" for i in range(P))
    sums = ["sum(n) AS cnt", *[f"sum((v{i} - o{i}) * n) AS s{i}" for i in range(P)],
            *[f"sum((v{i} - o{i}) * (v{j} - o{j}) * n) AS s{i}{j}" for i, j in PAIRS]]
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["cnt", *_SUMS])
    ctes = [r"""docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
parts AS (SELECT n, doc_id, lang, source, text,
  list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT n, unnest(range(1, len(words) - 1)) AS i,
  unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS w FROM parts),
repeats AS (SELECT n, i FROM windows QUALIFY count(*) OVER (PARTITION BY n, w) > 1),
covered AS (SELECT n, sum(c) AS n_repeat_words FROM (
  SELECT n, least(3, coalesce(lead(i) OVER (PARTITION BY n ORDER BY i) - i, 3)) AS c FROM repeats) GROUP BY n),
stats AS MATERIALIZED (SELECT p.n, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM parts p LEFT JOIN covered c ON p.n = c.n),
rated AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
vectors AS MATERIALIZED (SELECT n, lang, source, CAST(round(1000 * ln(word_chars / n_words)) AS BIGINT) AS v0,
  CAST(round(1000 * ln(1 + n_symbols / n_words)) AS BIGINT) AS v1,
  CAST(round(1000 * ln(1 + n_dup_lines / n_lines)) AS BIGINT) AS v2,
  CAST(round(1000 * ln(1 + n_repeat_words / n_words)) AS BIGINT) AS v3 FROM rated WHERE NOT base_failed)"""]
    ctes.append(f"folded AS MATERIALIZED (SELECT lang, source, {vs}, CAST(count(*) AS BIGINT) AS n FROM vectors GROUP BY ALL)")
    ctes.append("origin AS MATERIALIZED (SELECT lang, source, " + ", ".join(f"quantile_disc(v{i}, 0.5) AS o{i}" for i in range(P))
                + " FROM vectors GROUP BY lang, source)")
    ctes.append("spread AS MATERIALIZED (SELECT lang, source, " + ", ".join(f"quantile_disc(abs(v{i} - o{i}), 0.5) AS g{i}" for i in range(P))
                + " FROM vectors JOIN origin USING (lang, source) GROUP BY lang, source)")
    ctes.append(f"totals AS (SELECT lang, source, 2 AS start, {origins}, {', '.join(sums)} FROM folded JOIN origin USING (lang, source) "
                f"GROUP BY lang, source, {origins})")
    ctes.append(f"whole AS (SELECT lang, source, start, {origins}, {doubles} FROM totals)")
    ctes += _sql_estimates("third", "whole", 1.0)

    def plain(start: int, scale) -> str:
        cols = [f"CAST(o{i} AS DOUBLE) AS m{i}" for i in range(P)] + [f"{scale(i) if i == j else '0.0'}::DOUBLE AS c{i}{j}" for i, j in PAIRS]
        return f"SELECT lang, source, {start} AS start, {', '.join(cols)}, 'inf'::DOUBLE AS det FROM origin JOIN spread USING (lang, source)"

    ctes.append("est0 AS MATERIALIZED (" + plain(0, lambda i: f"{float(FLOORS[i])}") + " UNION ALL " + plain(
        1, lambda i: f"sqrt({float(FLOORS[i] ** 2)} + {SPREAD}::DOUBLE * g{i} * ({SPREAD}::DOUBLE * g{i}))")
        + f" UNION ALL SELECT lang, source, start, {', '.join(names[:-1])}, 'inf'::DOUBLE FROM third)")
    for k in range(STEPS):
        ctes.append(f"far{k} AS MATERIALIZED ({_sql_distance('folded', f'est{k}')})")
        ctes.append(f"bins{k} AS MATERIALIZED (SELECT lang, source, start, {origins}, CAST(floor({BINS} * ln(1 + d2)) AS BIGINT) AS bin, "
                    f"{', '.join(sums)} FROM far{k} JOIN origin USING (lang, source) GROUP BY lang, source, start, {origins}, bin)")
        ctes.append(f"placed{k} AS MATERIALIZED (SELECT *, "
                    "coalesce(sum(cnt) OVER (PARTITION BY lang, source, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
                    f"(sum(cnt) OVER (PARTITION BY lang, source, start) + {P + 1}) // 2 AS half FROM bins{k})")
        ctes.append(f"core{k} AS MATERIALIZED (SELECT lang, source, start, {origins}, "
                    "max(CASE WHEN before + cnt > half THEN CAST(half - before AS DOUBLE) / CAST(cnt AS DOUBLE) END) AS share, "
                    + ", ".join(f"CAST(coalesce(sum({c}) FILTER (before + cnt <= half), 0) AS DOUBLE) "
                                f"+ CAST(coalesce(sum({c}) FILTER (before + cnt > half), 0) AS DOUBLE) * coalesce(share, 0.0) AS {'n_' if c == 'cnt' else ''}{c}"
                                for c in ["cnt", *_SUMS]) + f" FROM placed{k} WHERE before < half GROUP BY lang, source, start, {origins})")
        ctes[-1] = ctes[-1].replace("coalesce(share, 0.0)", "coalesce(max(CASE WHEN before + cnt > half THEN CAST(half - before AS DOUBLE) / CAST(cnt AS DOUBLE) END), 0.0)")
        ctes.append(f"half{k} AS (SELECT * EXCLUDE (n_cnt), n_cnt AS cnt FROM core{k})")
        ctes += _sql_estimates(f"new{k}", f"half{k}", factor)
        moved = f"n.det < e.det * (1 - {GAIN!r}::DOUBLE)"
        ctes.append(f"est{k + 1} AS MATERIALIZED (SELECT lang, source, start, "
                    + ", ".join(f"CASE WHEN {moved} THEN n.{c} ELSE e.{c} END AS {c}" for c in names)
                    + f" FROM est{k} e JOIN new{k} n USING (lang, source, start))")
    best = ", ".join(f"best.{c} AS {c}" for c in names[:-1])
    packed = ", ".join(f"'{c}': {c}" for c in names[:-1])
    ctes.append(f"chosen AS MATERIALIZED (SELECT lang, source, {best} FROM (SELECT lang, source, "
                f"arg_min({{{packed}}}, (det, start)) AS best FROM est{STEPS} GROUP BY lang, source))")
    ctes.append(f"final AS MATERIALIZED ({_sql_distance('vectors', 'chosen')})")
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(d2, 3) AS distance,
       coalesce(d2 <= {limit!r}::DOUBLE, false) AS kept
FROM rated LEFT JOIN (SELECT n, d2 FROM final) f USING (n)""")


@query("op7_quality_rules", _sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the robust outlier verdict for all documents."""
    judged = judge_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"),
                           carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select(
        "doc_id", *[F.col(f"_{c}").alias(c) for c in names], F.round("_d2", 3).alias("distance"), F.col("_kept").alias("kept"))
