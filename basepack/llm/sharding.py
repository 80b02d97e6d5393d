"""Sharding by jump consistent hashing, and gapless slots within each shard.

The shard of a key depends on the key and the number of shards only, without a ring table; with one
shard more, a key stays or moves into the new shard.  Slots follow the doc_id within a shard.  They
come from ranges of (shard, doc_id): rows of each range are numbered on their own, and a running
sum over the ranges' counts, of which there are few, gives each range its first slot.  Texts are
not shuffled.

Null texts count as empty; a null doc_id has the key of 0 and sorts first.  Rows with equal doc_id
are in one shard, in slots of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

SHARDS = 40
#: Bytes that each document takes besides its text.
OVERHEAD = 16


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in [0, buckets) of each 64-bit key."""
    key = keys.astype(np.uint64).copy()
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(float))).astype(np.int64)
        live = live[j[live] < buckets]
    return b


@F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]))
def _shards(key: pd.Series, n: pd.Series) -> pd.DataFrame:
    k, out = key.to_numpy().astype(np.int64).view(np.uint64), {"shard": np.zeros(len(key), np.int32), "grown_shard": np.zeros(len(key), np.int32)}
    for many in np.unique(n):
        at = (n == many).to_numpy()
        out["shard"][at], out["grown_shard"][at] = jump_hash(k[at], int(many)), jump_hash(k[at], int(many) + 1)
    return pd.DataFrame(out)


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    ws = Workspace(df.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("to", _shards(F.coalesce("doc_id", F.lit(0)), F.lit(shards))).select("doc_id", "size", "text_crc32", "to.*")
    order = ["shard", "doc_id", "size", "text_crc32"]
    ranged = ws.write("rows", rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    out = ranged.withColumn("local", local).join(first, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("local")).alias("slot"), "grown_shard")


def op8_jump_hash_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

