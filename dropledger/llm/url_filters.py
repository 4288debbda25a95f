"""URL filters: a sort-merge range join of canonical keys with nested rules.

A rule (host, path prefix, verdict) fits its host and all subdomains, for
paths that start with its prefix; of the rules that fit, the longest wins (on
equal length the one with the longer host, which is the deeper one).

Canonical keys are the reversed host labels.  Since a rule fits subdomains and
the path comes after the host, a page is probed once for each host suffix that
is as deep as some rule: ``www.example.com/a`` as ``com``, ``com.example`` and
``com.example.www``, each with the path ``/a``.  Under one suffix a rule is
the interval of paths from its prefix up to the prefix followed by the byte
FF, which no UTF-8 text holds; intervals are nested or apart.

The sweep sorts rule starts, probes and rule ends of a suffix.  The running
count of starts less ends is the height of the stack of active rules, and slot
h of the stack holds the last rule opened at height h, so the top of the stack
at a probe is the last rule opened at the probe's height: two window functions
over one sort-based shuffle.  Probes of a busy suffix are dealt over several
sweeps, each with all rules of that suffix; suffixes without a rule drop out
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropledger.llm.catalog import query
from dropledger.llm.common import materialise, read_table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Probes of one suffix that one sweep takes, about.
PROBES_PER_SWEEP = 2_000
#: Rules up to which tables with a row for each host suffix are broadcast; beyond that the joins shuffle.
BROADCAST_RULES = 100_000

#: The contract's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _suffix(labels: Column, depth: Column) -> Column:
    """The reversed last ``depth`` labels, joined."""
    return F.array_join(F.slice(F.reverse(labels), F.lit(1), depth), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct (host, path) of the pages that a rule fits, with ``rule`` and ``verdict``.

    ``rules`` has (host, path, verdict), with hosts in lower case; repeated
    rules count once (of several verdicts for one host and path, the least).
    """
    rules = (
        rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", r"\."))
        .select(
            F.size("labels").alias("depth"),
            _suffix(F.col("labels"), F.size("labels")).alias("suffix"),
            "path", "verdict", F.concat("host", "path").alias("rule"))
    )
    deepest, n_rules = rules.agg(F.max("depth"), F.count(F.lit(1))).first()

    def by_suffix(table: DataFrame) -> DataFrame:
        """A table of at most a row for each rule: broadcast while there are few rules."""
        return F.broadcast(table) if n_rules <= BROADCAST_RULES else table

    host, path = host_and_path(F.col(url_col))
    places = materialise(
        pages.where(F.col(url_col).isNotNull()).select(host.alias("host"), path.alias("path")).distinct(),
        "url-places")
    labels = F.split("host", r"\.")
    suffixes = rules.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_rules"))
    probes = (
        places.withColumn("labels", labels)
        .withColumn("depth", F.explode(F.sequence(F.lit(0), F.least(F.size("labels"), F.lit(deepest or 0)))))
        .where("depth > 0")
        .select("host", "path", _suffix(F.col("labels"), F.col("depth")).alias("suffix"))
        .join(by_suffix(suffixes), "suffix")
    )
    sweeps = probes.groupBy("suffix").agg(
        (1 + F.floor(F.count(F.lit(1)) / PROBES_PER_SWEEP)).cast("int").alias("n_sweeps"))
    probes = probes.join(by_suffix(sweeps), "suffix").select(
        "suffix", F.pmod(F.xxhash64("host", "path"), F.col("n_sweeps")).cast("int").alias("sweep"),
        F.encode("path", "UTF-8").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "host", "path",
        F.lit(None).cast("struct<rule:string,verdict:string,depth:int,path:string>").alias("opened"))
    dealt_rules = rules.join(sweeps, "suffix").withColumn(
        "sweep", F.explode(F.sequence(F.lit(0), F.col("n_sweeps") - 1)))
    opened = F.struct("rule", "verdict", "depth", "path")
    nothing = F.lit(None).cast("string")
    key = F.encode("path", "UTF-8")
    starts = dealt_rules.select(
        "suffix", "sweep", key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"),
        nothing.alias("host"), nothing.alias("path"), opened.alias("opened"))
    ends = dealt_rules.select(
        "suffix", "sweep", F.concat(key, F.expr("X'FF'")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"),
        nothing.alias("host"), nothing.alias("path"), F.lit(None).cast(starts.schema["opened"].dataType).alias("opened"))
    # Ends sort behind everything that they enclose, so starts, probes and ends need no further order.
    order = Window.partitionBy("suffix", "sweep").orderBy("key", "kind")
    slot = Window.partitionBy("suffix", "sweep", "height").orderBy("key", "kind")
    swept = (
        starts.unionByName(probes).unionByName(ends)
        .withColumn("height", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("top", F.last("opened", ignorenulls=True).over(slot.rowsBetween(Window.unboundedPreceding, 0)))
    )
    best = F.max_by("top", F.struct(F.length("top.rule"), "top.depth"))
    return (
        swept.where("kind = 1 AND height > 0")
        .groupBy("host", "path").agg(best.alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every page; ``default`` where no rule fits.

    Null urls and urls without ``://`` have empty host and path and so no
    rule.  Repeated rows and null ids stay; other columns aren't read.
    """
    host, path = host_and_path(text_or_empty(url_col))
    return (
        pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
        .join(judge_urls(pages, rules, url_col), ["host", "path"], "left")
        .select(F.col("_id").alias(id_col), "host", "path", "rule",
                F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )


SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
places AS (
  SELECT n, page_id, regexp_extract(rest, '^[^/?#]*') AS rawhost,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts),
hosts AS (
  SELECT n, page_id, path, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM places),
fits AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM hosts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM hosts LEFT JOIN fits USING (n)
"""


@query("op5_url_filters", SQL)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the contract's rules on the url of every page."""
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)
