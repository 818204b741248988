"""Helpers that several corpus operators use."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of a join is broadcast, after they were counted: a few MB of keys.
BROADCAST_ROWS = 100_000

#: Rows that Python makes objects of at a time.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or, if the session names none, one in the warehouse.

    A session of one machine has a local warehouse; on a cluster the warehouse is shared, and refused if it is a
    machine's own folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/skeinql-tables"
        local = where.startswith(("file:", "/"))
        if local and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Tables that this process wrote, and the session they are of.
_tables: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that later jobs read rows and not the lineage.

    It stays until ``forget`` or the end of the process, as results that are read later may depend on it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(forget)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing yet to be read depends on."""
    for f in frames:
        if (f.sparkSession, f.written_at) in _tables:
            _tables.remove((f.sparkSession, f.written_at))
        _delete(f.sparkSession, f.written_at)


def forget() -> None:
    """Deletes all tables that ``written`` made; results that were not yet read are lost."""
    while _tables:
        _delete(*_tables.pop())


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is hashed by partition: for keys that grow with the corpus, at any size."""
    return df.hint("shuffle_hash")


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most BROADCAST_ROWS rows, else as it is (a shuffle join).

    For tables that are small by nature, as one row a source, and may not be.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a prefix that no column of ``df`` has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows, so that what a task makes of them at once is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Gives memory that a task has freed back to the system, as Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, by: int):
    """crc32 of a column's text form, modulo ``by``: the folds of the contracts. A null is as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` of ``rows`` in all, each value of ``key`` with an equal quota, by a hash of doc_id; the same every time.

    The values are counted first, over all rows; a value with fewer rows than its quota keeps them all.
    """
    value, n = fresh(rows, "value", "n")
    counts = written(rows.groupBy(F.col(key).alias(value)).agg(F.count("*").alias(n)), "sample-counts")
    quota = bound / max(1, counts.count())
    big = 1 << 30
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(big))
    sampled = rows.join(small_or_shuffled(counts), F.col(key).eqNullSafe(F.col(value)))
    return sampled.where(part < F.floor(big * F.least(F.lit(1.0), quota / F.col(n)))).select(*rows.columns)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of a bounded sample of labelled documents, both classes alike, outside the held-out fold.

    The labels are sampled, so what joins the documents has about ``bound`` rows at any size; doc_ids that are
    labelled twice have the larger label.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    ids = bounded_sample(ids.where(remainder("doc_id", 5) != 0), "__label", bound).select(F.col("doc_id").alias("__id"), "__label")
    return docs.join(small_or_shuffled(written(ids, "labels")), docs["doc_id"] == F.col("__id")).select("text", F.col("__label").alias("label"))
