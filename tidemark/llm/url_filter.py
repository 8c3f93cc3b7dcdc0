"""URL filters: host-suffix and path-prefix expressions, met with rules by hash.

A rule (host, path, verdict) fits a URL whose host is the rule's or one of its subdomains and whose path starts with the rule's.
Every URL is expanded only to the expressions that some rule could equal: the label counts and path lengths that occur in the rules.
Expressions meet rules in an equi-join on the first 8 hex digits of their SHA-256; the full digest is then compared.
The longest rule wins; among rules of one length the one with the longer host, then a block.

Nulls and texts without `://` have an empty host and path and get the default verdict, unless a rule fits those. Repeated rows are
judged each; an empty table gives an empty result; an empty rule table leaves the default. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _hashed(expression: Column) -> Column:
    return F.sha2(expression, 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict."""
    host, path = url_parts(F.col(f"`{url}`"))
    judged = pages.select(F.struct(*[f"`{c}`" for c in pages.columns]).alias("page"), host.alias("host"), path.alias("path"))
    ruled = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    shapes = ruled.select(F.size(F.split("rule_host", "\\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    keys = judged.select("host", "path").distinct()
    labels = F.size(F.split("host", "\\."))
    expressions = [
        F.when((labels >= s.labels) & (F.length("path") >= s.chars), F.concat(F.substring_index("host", ".", -s.labels), F.lit("\n"), F.substr("path", F.lit(1), F.lit(s.chars)))) for s in sorted(shapes)
    ]
    expanded = keys.select("host", "path", F.explode(F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")).alias("expression"))
    left = expanded.select("host", "path", _hashed(F.col("expression")).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    right = ruled.withColumn("rule_digest", _hashed(F.concat("rule_host", F.lit("\n"), "rule_path"))).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    met = left.join(right, "prefix").filter(F.col("digest") == F.col("rule_digest"))
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("chars"), F.length("rule_host").alias("host_chars"), (F.col("rule_verdict") == "block").alias("blocks"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best")
    )
    taken = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"page.`{c}`") for c in pages.columns if c.lower() not in taken]
    return judged.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
