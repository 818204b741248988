"""What the modules of queries share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from skeinql.operators.engine import Engine


def table(e: Engine, rows: Iterable, schema: str) -> DataFrame:
    """What a verb gave as a frame."""
    return e.catalog.spark.createDataFrame([tuple(r) for r in rows], schema)
