"""URL rules by hashed host-suffix / path-prefix expressions.

Every URL is expanded into the expressions a rule could be written as (each suffix of its host on label
boundaries, joined to each prefix of its path whose length occurs among the rules).  Expressions meet rules in
an equi-join on a short prefix of their SHA-256; the full digest confirms a meeting, and the longest confirmed
rule decides.

Defined results: a null URL or one without ``://`` has empty host and path; URLs without a fitting rule get the
default verdict and a null rule; of two rules with one expression "allow" wins; an empty rule or page table
works; very long URLs are read whole; repeated rows stay; further columns stay untouched, whatever their names (host, path,
rule and verdict are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Hexadecimal digits of the digest that the equi-join uses.
PREFIX_DIGITS = 8
#: Rules whose expressions have so many bytes at most are broadcast; more of them are joined by shuffle.
BROADCAST_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, most_labels: int, lengths: Sequence[int]) -> Column:
    """Host suffixes of up to most_labels labels, each joined to the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(most_labels))),
        lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."),
    )
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; rules has host, path and action ("allow" or "block")."""
    kept = F.struct(*[quoted(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("row")
    rules = rules.select(
        F.concat("host", "path").alias("expr"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("length"),
        F.col("action").alias("action"),
    )
    shape = rules.agg(F.max("labels").alias("labels"), F.collect_set("length").alias("lengths"), F.sum(F.octet_length("expr")).alias("bytes")).first()
    lengths = sorted(shape["lengths"]) or [0]
    rules = rules.groupBy("expr").agg(F.min("action").alias("action"))
    rules = rules.withColumn("digest", F.sha2(F.col("expr"), 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    if (shape["bytes"] or 0) <= BROADCAST_BYTES:
        rules = F.broadcast(rules)

    rows = pages.select(kept, F.col(quoted(url)).alias("url"))
    judged = rows.filter(F.col("url").contains("://"))  # others have no host, so no rule fits them
    urls = judged.select("url").distinct()
    asked = urls.select("url", F.explode(expressions(host_of(F.col("url")), path_of(F.col("url")), shape["labels"] or 1, lengths)).alias("asked"))
    asked = asked.withColumn("asked_digest", F.sha2(F.col("asked"), 256)).withColumn("short", F.substring("asked_digest", 1, PREFIX_DIGITS))
    met = asked.join(rules, "short").filter(F.col("asked_digest") == F.col("digest"))
    best = met.groupBy("url").agg(F.max(F.struct(F.length("expr").alias("n"), F.col("expr"), F.col("action"))).alias("best"))

    out = judged.join(best, "url", "left").select(
        "row.*",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.expr").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
    none = rows.filter(~F.coalesce(F.col("url").contains("://"), F.lit(False)))
    return out.unionByName(none.select("row.*", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
