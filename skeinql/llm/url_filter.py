"""URL filters with DataFrame functions only: host-suffix and path-prefix expressions, joined with rules on short hashes.

Each distinct (host, path) is expanded to the suffixes of its host at label borders times the prefixes of its path at
the lengths that rules' paths have. Expressions meet rules by an equi-join on the first PREFIX hexadecimal digits of
their SHA-256 digests; the full digests confirm; of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.llm.shared import shuffled, small_or_shuffled

PREFIX = 8
#: Rules (verdict, host, path) of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as literals of the plan, so that no Python worker makes rows of them."""
    rows = [F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True))) for r in rules]
    some = F.array(*rows) if rows else F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(some))


def _hashed(df: DataFrame, expression: str) -> DataFrame:
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn("short", F.substring("digest", 1, PREFIX))


def filtered(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id and url are read).

    A null or empty url, or one without ``://``, has an empty host and path. Where no rule fits, rule is null and the
    verdict is ``default``. Urls of any length are read whole. Rows that repeat, or that have a null page_id, are rows of
    their own; equal urls are expanded once, and joined back by a shuffle of which AQE splits the partitions that a very
    common url makes large. A table without rows gives one; other columns of ``pages`` may have any name. ``rules`` are (verdict, host, path); of two with the same host and path, the one that blocks
    holds; rules with a null are left out. Equally long rules: the one with the longer host.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), "path", "verdict")
    rules = rules.groupBy("rule_host", "path").agg(F.max("verdict").alias("rule_verdict")).withColumn("rule", F.concat("rule_host", "path"))
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())  # as many as lengths of paths
    rules = _hashed(rules.select("rule", "rule_verdict", F.char_length("rule_host").alias("rule_size")), "rule").withColumnRenamed("digest", "rule_digest")

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select("page_id", F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path"))
    different = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spread = different.withColumn("suffix", F.explode(F.array_distinct(suffixes))).withColumn("prefix", F.explode(prefixes))
    spread = _hashed(spread.select("host", "path", F.concat("suffix", "prefix").alias("expression")), "expression")
    met = spread.join(small_or_shuffled(rules), "short").where("digest = rule_digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule"), "rule_size", "rule", "rule_verdict")).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", F.col("best.rule_verdict").alias("v"))
    out = parts.join(shuffled(best), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))


SQL = """
WITH rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
fits AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT host, path FROM parts) u
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
"""
