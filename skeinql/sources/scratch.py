"""Tables that a walk or a write leaves between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession

_kept: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new place under spark.checkpoint.dir or, if that is unset, under the warehouse; it goes when the process ends.

    A cluster whose session names neither a shared checkpoint folder nor a shared warehouse is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/skeinql-tables"
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(forget)
    _kept.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget() -> None:
    while _kept:
        remove(*_kept.pop())
