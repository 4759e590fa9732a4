"""Shuffled shards by a two-pass external shuffle.

Pass one is Spark's shuffle: seeded hashes scatter the rows uniformly into buckets small enough for memory. Pass two
shuffles each bucket by Fisher-Yates and writes it. Only one bucket is ever in memory.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import BROADCAST_ROWS, CLEANUP, assign, text_key
from scorewright.plans.staging import checkpoint_folder

SHARDS = 8
SEED = 29
#: Mean bytes of text in a bucket.
BUCKET_BYTES = 16_000_000


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def place(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Shard of an id by the highest of one seeded hash per shard: a new shard takes rows and no other row moves."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), doc_id, k).alias("h"), k.alias("k")))
    return F.array_max(draws)["k"]


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as Parquet, one folder a shard, and reads them back with ``shard, slot, grown_shard``.

    The law is ``key``: id and shard count decide the shard; ``grown_shard`` is the shard if there were one more.
    ``slot`` numbers a shard's rows from 0 without gaps, in shuffled order; a rerun gives the same rows the same place,
    but for rows equal in id and text, which may swap. Rows with null id lie in one shard; an id with many different
    texts has its rows in many buckets. An empty table gives an empty one; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/shards-{uuid4().hex}"
    total = docs.agg(F.sum(row_bytes(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    key = text_key(F.col("text"))
    df = assign(
        docs, shard=place(F.col("doc_id"), shards, seed), grown_shard=place(F.col("doc_id"), shards + 1, seed), __key=key,
        __bucket=F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), key), F.lit(buckets)).cast("int"),
    )
    counts = df.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    # one row per bucket, so the bound is known before the join
    df = df.join(F.broadcast(offsets) if shards * buckets <= BROADCAST_ROWS else offsets, ["shard", "__bucket"])

    kept = [c for c in df.columns if c not in ("__bucket", "__offset", "__key")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept) + ", slot long"

    def shuffled(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("__key", "ascending")])
        seeds = [seed, table.column("shard")[0].as_py(), table.column("__bucket")[0].as_py()]
        order = np.random.default_rng(seeds).permutation(table.num_rows)
        slots = table.column("__offset")[0].as_py() + np.arange(table.num_rows)
        return table.select(kept).take(order).append_column("slot", pa.array(slots, pa.int64()))

    kept_setting = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.groupBy("shard", "__bucket").applyInArrow(shuffled, schema)
        out.write.partitionBy("shard").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, kept_setting or "false")
    return spark.read.schema(out.schema).parquet(folder)
