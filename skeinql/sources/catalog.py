"""Where entities' rows come from."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from skeinql.errors import Code, Refused


#: Schemas of Parquet tables by place, length and time of change: finding one costs a job.
_schemas: dict[tuple, StructType] = {}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, with the schema that it had when it was read before, if nothing there has changed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        key = (path, found.getLen(), found.getModificationTime())
    except Py4JJavaError:  # a pattern, or not there: Spark says which
        return spark.read.parquet(path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


class Catalog:
    """DataFrames by entity name: given, read from Parquet files ``{root}/{name}.parquet``, or tables of the session."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None, root: str | None = None):
        self.spark, self.frames, self.root = spark, dict(frames or {}), root

    def frame(self, name: str) -> DataFrame:
        if name in self.frames:
            f = self.frames[name]
            return f() if callable(f) and not isinstance(f, DataFrame) else f
        if self.root is not None:
            self.frames[name] = parquet(self.spark, f"{self.root}/{name}.parquet")
            return self.frames[name]
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise Refused(Code.UNKNOWN_NAME, f"no rows for {name}")

    def view(self, name: str, frame: DataFrame) -> None:
        """A derived, read-only root."""
        self.frames[name] = frame
        frame.createOrReplaceTempView(name)
