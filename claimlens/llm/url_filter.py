"""Operator 9. URL filters: host-suffix and path-prefix expressions, matched by hash prefix.

A URL's host and path expand into every host suffix (at dots) joined to every path prefix
that a rule could name. Expressions and rules meet by equi-join on the first hex digits of
their SHA-256; the full digests confirm a meeting, and the longest rule decides. Each
distinct (host, path) is judged once, with Spark SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.shared import cut, pick

#: Hex digits of the digest that the join compares.
PREFIX = 8
DEFAULT = "allow"
#: (verdict, host, path): the rules of the production query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of (page_id, url): page_id, host, path, rule, verdict.

    `rules` has (verdict, host, path). A rule fits its host and all subdomains if the URL's
    path starts with the rule's. The longest host plus path wins, block before allow among
    equals, then the smaller rule. Without a rule, rule is null and the verdict `default`.
    A null url, or one without ://, has empty host and path. Rules with a null part are
    ignored; repeated rules count once. Page ids may be null or repeat; further columns are
    ignored, whatever they are called, and an empty table of either kind is no error. URLs and
    rules of any length are read whole; of hosts, also of rules, A-Z alone are lower-cased.

    The planner broadcasts the rules only where their measured size is below its threshold;
    else both sides are shuffled by hash prefix, and frequent expressions split as skewed."""
    pages = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = pick(rules, "verdict", "host", "path").dropna().withColumn("host", F.translate("host", _UPPER, _LOWER)).distinct()
    full = _digest(F.col("host"), F.col("path"))
    rules = rules.select(F.substring(full, 1, PREFIX).alias("short"), full.alias("full"), "verdict", F.concat("host", "path").alias("rule"), (F.length("host") + F.length("path")).alias("long"), F.length("path").alias("path_long"), F.col("path").endswith("/").alias("slash"), F.size(F.split("host", r"\.")).alias("labels"))
    # What rules can name: path lengths (by whether all such paths end at a slash) and the most labels of a host.
    shapes = rules.groupBy("path_long").agg(F.bool_and("slash").alias("slash"), F.max("labels").alias("labels")).collect()
    suffix_labels = max((r["labels"] for r in shapes), default=1)
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - (suffix_labels - 1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    fits = [(r["path_long"], F.substring("path", r["path_long"], 1) == "/" if r["slash"] and r["path_long"] else F.length("path") >= r["path_long"]) for r in shapes]
    prefixes = F.array_compact(F.array(*[F.when(fit, F.substring("path", 1, n)) for n, fit in fits])) if fits else F.array().cast("array<string>")
    named = urls.withColumn("host_end", F.explode(suffixes)).withColumn("path_start", F.explode(prefixes))
    asked = named.withColumn("asked", _digest(F.col("host_end"), F.col("path_start"))).withColumn("short", F.substring("asked", 1, PREFIX))
    met = asked.join(rules.select("short", "full", "verdict", "rule", "long"), "short").where("asked = full")
    best = met.groupBy("host", "path").agg(F.min(F.struct((-F.col("long")).alias("long"), (F.col("verdict") != "block").alias("mild"), "rule", "verdict")).alias("best"))
    # Written first: joined to a table instead of to an aggregate of its own stage, a frequent URL's rows can be split.
    best = cut(best)
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
