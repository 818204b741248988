"""Filters and projections over a stream: the same definitions, compiled against a streaming frame.

An extension; sorting, paging and joins to many are for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skeinql.errors import Code, Refused
from skeinql.plans.compiler import Compiler, tables_of
from skeinql.plans.query import Query
from skeinql.sources.catalog import Catalog


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they come."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def streamed(catalog: Catalog, q: Query, stream: DataFrame) -> DataFrame:
    """The query over ``stream`` in place of its root; to-one joins read the catalog's tables."""
    if q.grouped or q.order or q.children or any(t.many for i in (*q.items, *q.condition.terms) for t in tables_of(i)):
        raise Refused(Code.TO_MANY_SELECTION, "a stream is filtered and projected only")
    return Compiler(catalog, dict(q.params)).query(q.checked(), narrowed=stream).visible()


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and a column, with a watermark for late rows."""
    from pyspark.sql import functions as F

    times = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return times.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
