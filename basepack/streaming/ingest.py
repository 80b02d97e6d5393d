"""Sequences that keep arriving, encoded and cut into chunks as they come.

Encoding is a projection, so it needs no state: each micro-batch's rows become chunk rows, once,
with the sink's own checkpoint.  ``lengths`` keeps the running length of each record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunks import CHUNK_BASES, chunk_records


def read(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """(name, seq) rows of Parquet files as they appear below ``path``."""
    return spark.readStream.schema("name string, seq string").option("maxFilesPerTrigger", files_a_batch).parquet(path)


def chunks(stream: DataFrame, arch: str = "4bit", chunk_bases: int = CHUNK_BASES) -> DataFrame:
    return chunk_records(stream, arch, chunk_bases, on_non_ascii="N")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def lengths(stream: DataFrame) -> DataFrame:
    return stream.groupBy("name").agg(F.sum(F.length("seq")).alias("logical_length"))
