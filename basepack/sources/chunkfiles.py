"""Stores of plain chunk files, ``<store>/c/<array>[_<component>]_<i>``, and result tables."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.compress import compressor as compressor_of
from ..workspace import ship
from . import files

#: A store that holds this file is complete.
DONE = ".benchmark_complete.json"


def write_store(path: str, chunks: DataFrame, attributes: dict, compressor: str = "none", force: bool = False) -> bool:
    """Whether the store was built: a complete one stays unless ``force``.  Empty payloads have no files."""
    if not force and files.exists(f"{path}/{DONE}"):
        return False
    files.remove(path)
    ship(chunks.sparkSession)
    named = chunks.where(F.octet_length("payload") > 0).select(columns.chunk_name(F.col("array"), F.col("component"), F.col("chunk_idx")).alias("name"), "payload")

    def put(it):
        f, n = compressor_of(compressor), 0
        for b in it:
            for name, payload in zip(b.column("name").to_pylist(), b.column("payload").to_pylist()):
                files.write(f"{path}/c/{name}", f(payload))
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    written = named.mapInArrow(put, "n long").agg(F.sum("n")).first()[0]
    files.write(f"{path}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}).encode())
    files.write(f"{path}/{DONE}", json.dumps({"files": written}).encode())
    return True


def read_store(spark: SparkSession, path: str, arch: str, compressor: str, chunk_bytes: int) -> DataFrame:
    """(array, component, chunk_idx, payload), decompressed; a store that isn't there is an error."""
    if not files.exists(f"{path}/c"):
        raise FileNotFoundError(f"no chunk store: {path}")
    rows = spark.read.format("binaryFile").load(f"{path}/c").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    pattern = r"^(.+?)(?:_(seq|flag))?_([0-9]+)$"
    part = F.regexp_extract("file", pattern, 2)
    component = F.when(part == "", F.lit(arch)).otherwise(F.concat(F.lit(f"{arch}_"), part))
    return rows.select(F.regexp_extract("file", pattern, 1).alias("array"), component.alias("component"), F.regexp_extract("file", pattern, 3).cast("long").alias("chunk_idx"), columns.decompress(F.col("content"), F.lit(chunk_bytes), compressor).alias("payload"))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, allocated) of all files below a folder; allocated bytes are of local files only."""
    ship(spark)

    def stat(it):
        for b in it:
            taken = [files.allocated(f"{path}/{p}") for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "length": b.column("length"), "allocated": pa.array(taken, pa.int64())})

    return files.listing(spark, path).mapInArrow(stat, "path string, length long, allocated long")


def storage_bytes(spark: SparkSession, path: str) -> dict:
    """Apparent and allocated bytes and number of all files below a store, the done-marker included."""
    size, taken, n = sizes(spark, path).agg(F.sum("length"), F.sum("allocated"), F.count("*")).first()
    marker = files.read(f"{path}/{DONE}")  # Spark lists no file whose name begins with a dot
    if marker is not None:
        size, taken, n = (size or 0) + len(marker), (taken or 0) + (files.allocated(f"{path}/{DONE}") or 0), n + 1
    return {"apparent_bytes": size or 0, "physical_bytes": taken or 0, "file_count": n}


def write_results(df: DataFrame, path: str) -> bool:
    """One CSV part with a header; nothing for an empty frame."""
    if df.isEmpty():
        return False
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a report: a row for each run
    return True


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
