"""Quality rules with DataFrame functions only: counts of each text, and verdicts on the hosts that they come from.

Failures of the base rules are summed by host; a beta prior is fitted to all hosts' rates by moments, and shrinks each
host's rate. A host is bad, and none of its documents is kept, if its posterior rate lies above what the prior makes of
hosts: if BELOW deviations under its posterior mean are still over ABOVE deviations over the prior's mean, which limit
is kept within LEAST to MOST.

A null text is an empty one: no words, and fails. Texts of any length are read whole. Documents that repeat, or that have
a null doc_id, are rows of their own; those without a host are judged by the base rules alone. A table without rows gives
one. Only doc_id, text and the host column are read; other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinql.llm.shared import WORD, small_or_shuffled, written

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Deviations of the posterior below its mean, and of the prior above its own, between which a bad host leaves a gap.
BELOW, ABOVE = 2.0, 3.0
#: A host whose posterior rate may be this low is not bad, however good the others are; one surely above that is, however bad they are.
LEAST, MOST = 0.2, 0.5


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more.

    Windows are chained 64-bit hashes of their words: three doublings make hashes of 2, 4 and 8 words. The starts of
    windows seen twice, in order, cover min(WINDOW, distance to the next such start) words each.
    """

    def doubled(h: Column, by: int) -> Column:
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - by), F.slice(h, F.lit(by + 1), F.size(h) - by), lambda a, b: F.xxhash64(a, b))

    def let(value: Column, body) -> Column:  # evaluated once, where it is needed
        return F.element_at(F.transform(F.array(value), body), 1)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(s: Column) -> Column:
            steps = F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda p: let(starts(p), total))

    one = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(one, lambda a: let(doubled(a, 1), lambda b: let(doubled(b, 2), lambda c: doubled(c, 4))))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row of ``docs``."""
    df = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(judged: DataFrame, below: float = BELOW, above: float = ABOVE, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(host, n, failed, rate, limit, bad): failures by host, the posterior mean, and the verdict; one row a host, none for a null host.

    Prior by moments, hosts weighing as their documents: with the rates' mean m and variance v, of which s is what
    sampling alone would give, strength m (1 - m) / (v - s) - 1, kept within 1 to 1000; a single host, or hosts no more
    different than by chance, give the strongest.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q"), F.count("*").alias("h")).first()  # four numbers
    every = float(prior["n"] or 1)
    m = (prior["f"] or 0) / every
    v = (prior["q"] or 0.0) / every - m * m - m * (1 - m) * (prior["h"] / every)
    strength = max(1.0, min(1000.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    limit = max(least, min(most, m + above * math.sqrt(m * (1 - m) / (strength + 1))))
    mean = (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    out = hosts.withColumn("rate", mean).withColumn("limit", F.lit(limit))
    return out.withColumn("bad", F.col("rate") - below * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength + 1))) > F.col("limit"))


def judged(docs: DataFrame, host: str = "source", below: float = BELOW, above: float = ABOVE, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Counts and verdicts for each row of ``docs``.

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad, kept).
    """
    base = written(measured(docs, host), "measured")
    bad = written(host_verdicts(base, below, above, least, most).where("bad").select("host", "bad"), "bad-hosts")
    out = base.join(small_or_shuffled(bad), "host", "left").withColumn("host_bad", F.coalesce("bad", F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_bad", (~F.col("base_failed") & ~F.col("host_bad")).alias("kept"))


SQL = """
WITH base AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
counted AS (SELECT b.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
failed AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM counted),
hosts AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM failed WHERE host IS NOT NULL GROUP BY host),
moments AS (SELECT m, q - m * m - m * (1 - m) * i AS v FROM (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS i FROM hosts)),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1, least(1000, m * (1 - m) / v - 1)) ELSE 1000 END AS s FROM moments),
posterior AS (SELECT host, n, s, (f + m * s) / (n + s) AS rate, greatest(0.2, least(0.5, m + 3 * sqrt(m * (1 - m) / (s + 1)))) AS upto FROM hosts, prior),
bad AS (SELECT host FROM posterior WHERE rate - 2 * sqrt(rate * (1 - rate) / (n + s + 1)) > upto)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bad.host IS NOT NULL AS host_bad, NOT base_failed AND bad.host IS NULL AS kept
FROM failed LEFT JOIN bad ON failed.host = bad.host
"""
