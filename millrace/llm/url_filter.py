"""URL filters by host-suffix and path-prefix expressions (DataFrame operations only).

Every URL expands into (host suffix, path prefix) expressions, for the label counts and path lengths that rules have.
Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; the full digest confirms, and the longest
rule wins.  Expansion runs over distinct (host, path) pairs, so a hot host is aggregated before it is shuffled.  What was found is
written before pages are joined with it: both sides are plain exchanges then, and Spark can split the rows of a hot URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
SHORT = 8  # hex digits of a digest that make the join key
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where ``://`` is missing."""
    return (F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", no_host: str = "block") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict.

    rules: host, path, verdict (``allow`` or ``block``).  A rule fits its host and all subdomains if the path starts
    with the rule's.  The longest rule string wins, then the longer host, then ``block``.  Without a rule the verdict
    is ``default``, or ``no_host`` where the URL has no host to look up.  Every input row comes back once, repeated rows
    and null URLs too; columns of ``pages`` named like a new one are replaced; rules with a null are ignored; with no
    rules only the defaults apply.  URLs of any length are read whole, but only as many expressions come of one as rules have sizes.  No pages give no rows.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    # Bounded: at most 127 labels a host, and as many path lengths as URLs can have.
    sizes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    counts = F.array(*[F.lit(x) for x in sorted(sizes.labels)]).cast("array<int>")
    lengths = F.array(*[F.lit(x) for x in sorted(sizes.lengths)]).cast("array<int>")

    host, path = host_and_path(F.col(url))
    pages = with_columns(pages, {"host": host, "path": path})
    labels = F.split("host", r"\.")
    pairs = (
        pages.filter("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(F.filter(counts, lambda n: n <= F.size(labels))).alias("n"))
        .select("host", "path", F.array_join(F.slice(labels, -F.col("n"), F.col("n")), ".").alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
        .select("host", "path", _digest(F.col("suffix"), F.expr("substring(path, 1, n)")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    blocked = F.when(F.col("verdict") == "block", 1).otherwise(0)
    string = F.concat("host", "path")
    known = (
        rules.select(_digest(F.col("host"), F.col("path")).alias("rule_digest"), F.struct(F.length(string), F.length("host"), blocked, string.alias("rule"), F.col("verdict")).alias("found"))
        .groupBy("rule_digest").agg(F.max("found").alias("found"))
        .withColumn("short", F.substring("rule_digest", 1, SHORT))
    )
    best = (
        pairs.join(known, "short").filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(F.max("found").alias("__found"))
    )
    best = written(best, "verdicts")
    fallback = F.when(F.col("host") == "", no_host).otherwise(default)
    out = pages.join(best, ["host", "path"], "left")
    kept = [F.col(c) for c in pages.columns if c.lower() not in ("rule", "verdict")]
    return out.select(*kept, F.col("__found.rule").alias("rule"), F.coalesce("__found.verdict", fallback).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS rid FROM pages),
hits AS (SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hits USING (rid)
"""
