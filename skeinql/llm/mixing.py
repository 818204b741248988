"""Mixing sources to target weights with DataFrame functions only, by a low-discrepancy schedule of slots.

Slot i of the mix is the golden-ratio point i * MULTIPLIER mod 2**32; the source in whose stretch of the cumulative
targets it falls owns the slot. Each source's documents, shuffled by a hash of their ids, form a line of words that is
read up to ``repeats`` times over and cut into blocks of equal size; a source's k-th slot takes its k-th block. Slots are
few and blocks large where the corpus is, so what a source's slots give may lie off its target by more than a small source
has: each source is settled to the word, by its last block cut or by further slots at the end of the mix.

Positions on a line and ranks of slots are two-level sums (within a chunk, then over the chunks' totals), so that no
source is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinql.llm.shared import WORD, fresh, shuffled, small_or_shuffled, written

WEIGHTS, REPEATS = (5, 2, 1), 3
#: 2**32 over the golden ratio, odd: the points of 2**32 slots are distinct.
MULTIPLIER, CIRCLE = 2654435769, 4294967296
#: Words of a block: so few that the mix has about SLOTS slots, within these bounds.
SLOTS, LEAST_BLOCK, MOST_BLOCK = 131072, 16, 65536
_CELL = 65536


def block_size(total: int) -> int:
    return max(LEAST_BLOCK, min(MOST_BLOCK, total // SLOTS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, sid, source_size, target) of rows (source, source_size): one row a source, also without words.

    Weights are dealt by code point of the source, null last. A target is ``level * weight``, or ``repeats`` times the
    source's size if that is less, where level is such that targets share all words: with the sources in order of cap
    over weight, the greatest of (all words - caps before) / (weights from here on).
    """
    every, ranked = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("sid", (F.row_number().over(ranked) - 1).cast("int"))
    df = df.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)).cast("long")).withColumn("cap", F.col("source_size") * repeats)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("step", left.cast("double") / share.cast("double")).withColumn("level", F.max("step").over(every))
    return df.select("source", "sid", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _before(df: DataFrame, group: str, chunk: str, order: list[Column | str], size: Column) -> DataFrame:
    """Adds ``at``: the sum of ``size`` over all rows of the group that come earlier, by chunk and then by ``order``."""
    inside = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(group, chunk).agg(F.sum(size).alias("__total"))
    over = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offset = chunks.select(group, chunk, F.coalesce(F.sum("__total").over(over), F.lit(0)).cast("long").alias("__offset"))
    df = df.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("long"))
    return df.join(offset, [group, chunk]).withColumn("at", F.col("__in") + F.col("__offset")).drop("__in", "__offset")


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, sid, rank): the mix, a row for each slot in order of slot; the slot holds block ``rank`` of source ``sid``."""
    spark = targets.sparkSession
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    share = targets.select("sid", F.floor("target").cast("long").alias("t")).where("t > 0").withColumn("all", F.sum("t").over(Window.partitionBy())).withColumn("high", F.sum("t").over(upto))

    def point(x: Column) -> Column:
        return F.floor(x.cast("double") * float(CIRCLE) / F.col("all").cast("double")).cast("long")

    share = share.select("sid", point(F.col("high") - F.col("t")).alias("low"), point(F.col("high")).alias("high")).where("high > low")
    share = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / _CELL), F.floor((F.col("high") - 1) / _CELL))))
    slots = spark.range(math.ceil(total / block)).select(F.col("id").alias("slot"), (F.col("id") * F.lit(MULTIPLIER).cast("long") % F.lit(CIRCLE).cast("long")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / _CELL))
    owned = slots.join(share, "cell").where("low <= u and u < high").select("slot", "sid", F.floor(F.col("slot") / 4096).alias("part"))
    return _before(owned, "sid", "part", ["slot"], F.lit(1)).select("slot", "sid", F.col("at").alias("rank"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs`` (doc_id, text and source are read).

    taken: the words of the document in the blocks that the schedule takes, repeats counted, ``repeats`` times its size
    at most. Rows that repeat, or that have a null doc_id, are shuffled as rows of their own, those of one hash (ties) by
    doc_id and size. A null or empty text has no words and gets 0; texts of any length are counted whole. A null source is
    a source. An empty table gives none. Other columns of ``docs`` may have any name.
    Those of a source add up to its target, rounded down.
    """
    other = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("other")  # rows without an id are told apart by their texts
    base = docs.select("doc_id", other, F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = written(base, "sizes")
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block or block_size(total)
    targets = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")
    slots = written(schedule(targets, total, block), "schedule")
    limit = F.floor("target").cast("long")
    known = targets.join(slots.groupBy("sid").agg(F.count("*").alias("had")), "sid", "left").withColumn("known", F.col("source")).withColumn("had", F.coalesce("had", F.lit(0)).cast("long"))
    known = written(known.withColumn("limit", limit).withColumn("blocks", F.ceil(F.col("limit") / block)).drop("source"), "known")
    more = known.where("blocks > had").select("sid", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank"))
    slots = slots.select("sid", "rank").unionByName(more)
    known = small_or_shuffled(known.drop("had"))
    placed = base.join(known, base["source"].eqNullSafe(known["known"])).drop("known")

    depth = max(1, min(6, round(math.log(max(rows, 1), 16) / 2)))  # chunks about as many as the rows of one
    placed = placed.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), "other").cast("binary"))).withColumn("chunk", F.substring("h", 1, depth))
    placed = written(_before(placed, "sid", "chunk", ["h", "doc_id", "size"], F.col("size")).drop("h", "chunk", "source", "other"), "placed")

    line = placed.where("size > 0 and blocks > 0").withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("at") + e * F.col("source_size"))))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    line = line.where(first < F.col("blocks")).withColumn("rank", F.explode(F.sequence(first, F.least(last, F.col("blocks") - 1))))
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block, "limit") - F.greatest("start", F.col("rank") * block))
    taken = line.join(slots, ["sid", "rank"]).groupBy("sid", "at").agg(F.sum(part).alias("taken"))
    used = placed.where("size > 0").join(taken, ["sid", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return used.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix begins to read them, all columns as they are; rows it never reaches go.

    Rows of one doc_id share what is taken of all of them. Rows without an id, or without a word, have nothing
    to mix and stay as they are, once.
    """
    own, count, turn = fresh(docs, "id", "times", "turn")
    share = F.least(F.lit(repeats), F.ceil(F.sum("taken") / F.sum("size"))).cast("int")
    times = mixed(docs, weights, repeats).where("doc_id is not null and size > 0").groupBy(F.col("doc_id").alias(own)).agg(share.alias(count))
    out = docs.join(shuffled(times), docs["doc_id"] == F.col(own), "left").withColumn(turn, F.explode(F.array_repeat(F.lit(0), F.coalesce(count, F.lit(1)))))
    return out.select(*docs.columns)


SQL = """
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM base GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[(sid % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM sums),
steps AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS step
  FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, sid, source_size, least(cap::DOUBLE, max(step) OVER () * weight) AS target FROM steps),
placed AS (SELECT b.doc_id, b.size, t.sid, t.source_size, t.target,
    coalesce(sum(b.size) OVER (PARTITION BY t.sid ORDER BY md5(b.doc_id::VARCHAR), b.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(at_ + size, upto) - at_) + greatest(0, least(at_ + size + source_size, upto) - at_ - source_size)
   + greatest(0, least(at_ + size + 2 * source_size, upto) - at_ - 2 * source_size))::BIGINT AS taken
FROM (SELECT *, floor(target)::BIGINT AS upto FROM placed)
"""
