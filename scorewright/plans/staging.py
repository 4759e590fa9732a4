"""Cutting lineage between stages."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; local runs without one get their own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="scorewright-ckpt-")


def spread(df: DataFrame) -> DataFrame:
    """Rebalances a source that offers fewer splits than there are cores; large inputs pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes the table to the shared folder and reads it back.

    Later stages start from files: a lost executor costs no upstream work, and
    columns and partitions are pruned at the scan.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid4().hex}"
    spread(df).write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
