"""Recursive sources: one join a level, until a level is empty.

A walk runs when its source is compiled: each level is one job that joins the rows below the last level and writes them
to a table partitioned by level, so that a walk of d levels costs d joins, no lineage grows and nothing is held in memory.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinql.errors import Code
from skeinql.sources.scratch import folder

if TYPE_CHECKING:
    from skeinql.plans.compiler import Compiler
    from skeinql.plans.query import Source

#: Rows of a level up to which it is broadcast to the links; the walk knows each level's size.
BROADCAST_LEVEL = 100_000


def _key(fields: tuple[str, ...], side: str) -> Column:
    return F.struct(*(F.col(f"{side}.`{f}`") for f in fields))


def _refuse(when: Column, code: Code, why: str) -> Column:
    return F.when(when, F.raise_error(F.lit(f"{code.value} {code.name}: {why}")).cast("int")).otherwise(F.lit(0))


def walked(compiler: Compiler, s: Source) -> DataFrame:
    """Rows of ``s`` with the level, as the walk finds them; what it refuses is raised when rows are read.

    Each row carries the keys above it, so that a cycle is seen on the row that closes it. The walk goes one level
    beyond the deepest, to see whether there is more. A null parent is nobody's child.
    """
    r = s.recursion
    depth = r.depth or "__depth"
    names = s.query.names
    spark = compiler.catalog.spark
    path = folder(spark, f"walk-{s.name}")
    links = compiler.query(r.links).visible()

    def kept(level: DataFrame, d: int) -> tuple[DataFrame, int]:
        seen = Observation()
        at = f"{path}/__level={d}"
        level.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
        return spark.read.schema(level.schema).parquet(at), seen.get["n"]

    seeds = compiler.query(s.query).visible().alias("s")
    level, n = kept(seeds.select(*(F.col(f"s.`{x}`") for x in names), F.array(_key(r.child, "s")).alias("__path"), F.lit(False).alias("__cycle")), 0)
    schema = T.StructType([*level.schema.fields, T.StructField("__level", T.LongType())])
    for d in range(1, r.max_depth + 2):
        if not n:
            break
        above = level.where(~F.col("__cycle")).select(*r.child, "__path").alias("a")
        on = None
        for p, c in zip(r.parent, r.child, strict=True):
            term = F.col(f"l.`{p}`") == F.col(f"a.`{c}`")
            on = term if on is None else on & term
        own = F.struct(*(F.col(f"l.`{c}`") for c in r.child))
        below = links.alias("l").join(F.broadcast(above) if n <= BROADCAST_LEVEL else above, on)
        below = below.select(*(F.col(f"l.`{x}`") for x in names), F.concat(F.col("a.__path"), F.array(own)).alias("__path"), F.array_contains(F.col("a.__path"), own).alias("__cycle"))
        level, n = kept(below, d)
    out = spark.read.schema(schema).parquet(path).withColumnRenamed("__level", depth)
    checks = _refuse(F.col("__cycle"), Code.CYCLE, s.name) + _refuse(F.col(depth) > r.max_depth, Code.TOO_DEEP, f"{s.name} beyond {r.max_depth}")
    if r.tree:
        out = out.withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy(*r.child)))
        checks = checks + _refuse((F.col("__times") > 1) & ~F.col("__cycle"), Code.DUPLICATE_NODE, s.name)
    # the check is a filter over every row, so that no later pruning of columns drops it
    return out.where(checks == 0).select(*s.fields)
