"""Zarr groups and bare arrays of one-dimensional uint8, as tables of chunks: format 3, and format 2 to read.

Chunks are read by their names, which follow from the arrays' shapes, so no folder of chunks is
listed.  A chunk file holds a whole chunk, padded with zeros at the array's end; a missing file is a
chunk of zeros.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compress import compressor as compressor_of
from ..functions.compress import decompressor
from ..workspace import ship
from . import files

#: Names of codecs in array metadata; fixed values.
CODECS = {"zstd": "zstd", "gzip": "gzip", "zlib": "numcodecs.zlib", "bz2": "numcodecs.bz2", "lzma": "numcodecs.lzma", "lz4_block": "numcodecs.lz4"}
#: Identifiers of the same in format 2.
IDS = {"zstd": "zstd", "gzip": "gzip", "zlib": "zlib", "bz2": "bz2", "lzma": "lzma", "lz4": "lz4_block"}
#: Most bytes of a batch of chunks; bytes of chunks from which a task is added.
BATCH_BYTES, TASK_BYTES = 4 << 20, 64 << 20
ARRAYS = "array string, shape long, chunk_bytes long, compressor string, attributes string"


def _codecs(name: str, level: int | None) -> list[dict]:
    out = [{"name": "bytes"}]
    if name == "none":
        return out
    if name not in CODECS:
        raise ValueError(f"no Zarr codec for compressor {name}")
    config = {"zstd": {"level": 3 if level is None else level, "checksum": False}, "lzma": {"preset": 6}, "lz4_block": {"acceleration": 1}}.get(name, {"level": 6 if level is None else level})
    return [*out, {"name": CODECS[name], "configuration": config}]


def array_node(shape: int, chunk_bytes: int, compressor: str, attributes: dict, level: int | None = None) -> dict:
    return {
        "zarr_format": 3,
        "node_type": "array",
        "shape": [shape],
        "data_type": "uint8",
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [chunk_bytes]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0,
        "codecs": _codecs(compressor, level),
        "attributes": attributes,
    }


def _compressor_of(node: dict) -> str:
    names = [c["name"] for c in node["codecs"] if c["name"] != "bytes"]
    known = {v: k for k, v in CODECS.items()}
    if len(names) > 1 or any(n not in known for n in names):
        raise ValueError(f"unsupported codecs: {names}")
    return known[names[0]] if names else "none"


def _row(name: str, node: dict, attributes: dict) -> tuple:
    """(array, shape, chunk bytes, compressor, attributes) of an array's metadata, of either format."""
    three = node.get("zarr_format") == 3
    if len(node["shape"]) != 1 or (node["data_type"] if three else node["dtype"].lstrip("|<>")) not in ("uint8", "u1"):
        raise ValueError(f"not a one-dimensional uint8 array: {name}")
    if three:
        return name, node["shape"][0], node["chunk_grid"]["configuration"]["chunk_shape"][0], _compressor_of(node), json.dumps(attributes)
    codec = (node.get("compressor") or {"id": "none"})["id"]
    if node.get("filters") or codec not in (*IDS, "none"):
        raise ValueError(f"unsupported codecs: {codec}, {node.get('filters')}")
    return name, node["shape"][0], node["chunks"][0], IDS.get(codec, "none"), json.dumps(attributes)


def _json(path: str) -> dict:
    text = files.read(path)
    return json.loads(text) if text else {}


def read_group(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """(group attributes, arrays): name, shape, chunk bytes, compressor and attributes of each array."""
    ship(spark)
    group = _json(f"{root}/zarr.json")
    if not group:
        return _read_group2(spark, root)
    if group.get("zarr_format") != 3 or group.get("node_type") != "group":
        raise ValueError(f"not a Zarr v3 group: {root}")
    names = spark.createDataFrame([(n,) for n in files.folders(root)], "array string")

    def parse(it):
        for batch in it:
            out = []
            for name in batch.column("array").to_pylist():
                node = _json(f"{root}/{name}/zarr.json")
                if node.get("node_type") == "array":
                    out.append(_row(name, node, node.get("attributes", {})))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["array", "shape", "chunk_bytes", "compressor", "attributes"])

    return group.get("attributes", {}), names.mapInArrow(parse, ARRAYS)


def _read_group2(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """A group of format 2, whose metadata files are hidden ones and so are read on the driver: a few for each array."""
    if not files.exists(f"{root}/.zgroup"):
        raise FileNotFoundError(f"no Zarr group: {root}")
    found = [(name, _json(f"{root}/{name}/.zarray")) for name in files.folders(root)]
    rows = [_row(name, node, _json(f"{root}/{name}/.zattrs")) for name, node in found if node]
    return _json(f"{root}/.zattrs"), spark.createDataFrame(rows, ARRAYS)


def open_any(spark: SparkSession, root: str, array: str | None = None) -> tuple[dict, DataFrame]:
    """(attributes, arrays) of a group, or of a bare array, whose name is then empty.

    ``array``: this one of a group only; without it a group's arrays are all there.
    """
    node = _json(f"{root}/zarr.json")
    if node.get("node_type") == "array" or files.exists(f"{root}/.zarray"):
        attributes = node.get("attributes", {}) if node else _json(f"{root}/.zattrs")
        return attributes, spark.createDataFrame([_row("", node or _json(f"{root}/.zarray"), attributes)], ARRAYS)
    attributes, arrays = read_group(spark, root)
    return attributes, arrays if array is None else arrays.where(F.col("array") == array)


def _chunks(names: list, at: list, payloads: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"array": pa.array(names, pa.string()), "chunk_idx": pa.array(at, pa.int64()), "payload": pa.array(payloads, pa.binary())})


def read_chunks(spark: SparkSession, root: str, arrays: DataFrame, arch: str = "4bit") -> DataFrame:
    """(array, component, chunk_idx, payload) of all chunks, decompressed, trimmed to the array's shape.

    Of a ``2bit`` group, arrays ``<name>_seq`` and ``<name>_flag`` are components of ``<name>``.
    """
    ship(spark)
    n = F.ceil(F.col("shape") / F.col("chunk_bytes")).cast("long")
    some = arrays.where("shape > 0").select("array", "shape", "chunk_bytes", "compressor", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_idx"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, (arrays.agg(F.sum("shape")).first()[0] or 0) // TASK_BYTES)
    node = _json(f"{root}/zarr.json")
    folder = "c/" if node else ""  # of chunks, in format 3

    def run(it):
        for b in it:
            names, at, out, held = [], [], [], 0
            for array, shape, size, name, idx in zip(*(b.column(c).to_pylist() for c in ("array", "shape", "chunk_bytes", "compressor", "chunk_idx"))):
                raw = files.read(f"{root}/{array}/{folder}{idx}" if array else f"{root}/{folder}{idx}")
                full = bytes(size) if raw is None else decompressor(name)(raw, size)
                names.append(array)
                at.append(idx)
                out.append(full[: max(0, min(size, shape - idx * size))])
                held += len(out[-1])
                if held >= BATCH_BYTES:
                    yield _chunks(names, at, out)
                    names, at, out, held = [], [], [], 0
            yield _chunks(names, at, out)

    chunks = some.repartition(tasks, "array", "chunk_idx").mapInArrow(run, "array string, chunk_idx long, payload binary")
    if arch != "2bit":
        return chunks.select("array", F.lit(arch).alias("component"), "chunk_idx", "payload")
    part = F.regexp_extract("array", r"^(.*)_(seq|flag)$", 2)
    return chunks.where(part != "").select(F.regexp_extract("array", r"^(.*)_(seq|flag)$", 1).alias("array"), F.concat(F.lit("2bit_"), part).alias("component"), "chunk_idx", "payload")


def write_group(destination: str, attributes: dict, arrays: list[dict], chunks: DataFrame, compressor: str, level: int | None = None, overwrite: bool = False) -> str:
    """Writes beside the destination and moves the complete group there.

    ``arrays``: dicts with array, shape, chunk_bytes, attributes, one for each array, as metadata of
    a group is on the driver.  ``chunks``: (array, chunk_idx, payload), not compressed.
    """
    files.prepare_destination(destination, overwrite)
    nodes = {a["array"]: array_node(a["shape"], a["chunk_bytes"], compressor, a["attributes"], level) for a in arrays}
    temporary = f"{destination.rstrip('/')}.{uuid.uuid4().hex[:8]}.partial"
    # No join: its small side is not always the one that is broadcast, as shuffled chunks compress well.
    sizes = {a["array"]: a["chunk_bytes"] for a in arrays}
    ship(chunks.sparkSession)

    def put(it):
        f = compressor_of(compressor, level)
        done: dict[str, int] = {}
        for b in it:
            for array, idx, payload in zip(*(b.column(c).to_pylist() for c in ("array", "chunk_idx", "payload"))):
                if array not in sizes:
                    continue
                files.write(f"{temporary}/{array}/c/{idx}", f(payload + bytes(sizes[array] - len(payload))))
                done[array] = done.get(array, 0) + len(payload)
        yield pa.RecordBatch.from_pydict({"array": pa.array(done, pa.string()), "n": pa.array(done.values(), pa.int64())})

    try:
        files.write(f"{temporary}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}, indent=2).encode())
        for name, node in nodes.items():
            files.write(f"{temporary}/{name}/zarr.json", json.dumps(node, indent=2).encode())
        held = chunks.select("array", "chunk_idx", "payload").mapInArrow(put, "array string, n long").groupBy("array").agg(F.sum("n").alias("n")).collect()  # metadata: a row for each array
        held = {r.array: r.n for r in held}
        wrong = sorted(a["array"] for a in arrays if held.get(a["array"], 0) != a["shape"])
        if wrong:
            raise RuntimeError(f"packed length does not match the array's: {', '.join(wrong)}")
        if overwrite:
            files.remove(destination)
        files.move(temporary, destination)
    except BaseException:
        files.remove(temporary)
        raise
    return destination
