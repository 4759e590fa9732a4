"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.plans.staging import checkpoint_folder

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A joined side is broadcast up to this many rows of a few numbers each; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: Rows of whole texts in one Arrow batch. A task holds a batch several times over, in the JVM and in its Python worker.
ARROW_ROWS = 1000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; afterwards they are what they were, unset ones unset."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, **more: str):
    """Settings under which at most ARROW_ROWS rows go to a Python worker at once; a smaller bound of the session holds."""
    rows = int(spark.conf.get(BATCH))
    return settings(spark, {BATCH: str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS)} | more)


def staged(df: DataFrame, name: str = "llm", texts: bool = False) -> DataFrame:
    """Writes the table to the shared folder and reads it back.

    Whatever follows starts from files, so a lost executor costs no upstream work; the
    shuffle files of the finished job are dropped at once instead of at some later garbage collection.
    ``texts``: whole texts go to Python workers here, at most ARROW_ROWS at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"
    cleanup = {CLEANUP: "true"}
    with small_batches(spark, **cleanup) if texts else settings(spark, cleanup):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Frees what finished work left in the driver: Python's and Arrow's memory, and in the JVM broadcasts and shuffles that nothing holds any more."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.java.lang.System.gc()


_TABLES: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator.

    A worker serves many operators in turn. The first task of another one lets the tables go and gives their memory back,
    so what a worker holds is bounded by one operator's tables and not by the sum of all it has served.
    """
    if owner not in _TABLES:
        _TABLES.clear()
        _TABLES[owner] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return _TABLES[owner]


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a staged table for broadcast if its counted rows are within BROADCAST_ROWS."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def assign(df: DataFrame, **new: Column) -> DataFrame:
    """The input's columns with ``new`` behind them; a column of the same name is replaced."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def text_key(text: Column) -> Column:
    """64-bit key of a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
