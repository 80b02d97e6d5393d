"""Stores of one genome under many settings: built, opened, read request by request, and timed."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.compress import decompressor
from ..sources import chunkfiles, files, zarr3
from ..workspace import ship
from . import metrics, windows
from .chunks import chunk_records
from .store import pack_records

#: Name of the two-bit architecture on disk.
ON_DISK = {"2bit": "2bit_flag"}
#: The frame format of lz4 is no Zarr codec; its block format is.
ZARR_COMPRESSORS = {"lz4": "lz4_block"}


@dataclass(frozen=True)
class Setting:
    backend: str
    arch: str
    chunk_name: str
    chunk_bases: int
    compressor: str = "none"

    def attributes(self, records: list) -> dict:
        return {"backend": self.backend, "architecture": ON_DISK.get(self.arch, self.arch), "chunk_name": self.chunk_name, "logical_chunk_bases": self.chunk_bases, "compressor": self.compressor, "chromosomes": [{"name": r.name, "length": r.logical_length} for r in records]}


def _array_name(array, component):
    return F.concat(array, F.when(component.startswith("2bit_"), F.concat(F.lit("_"), F.substring_index(component, "_", -1))).otherwise(F.lit("")))


def build_store(records: DataFrame, path: str, setting: Setting, force: bool = False, lines: DataFrame | None = None) -> float:
    """Seconds that the build of (name, ordinal, logical_length, seq) took; 0 if a complete store is there.

    ``lines``: (name, position, line) instead of ``seq``, for records that are too long for a row.
    """
    if setting.backend not in ("manual", "zarr"):
        raise ValueError(f"unknown backend: {setting.backend}")
    if not force and files.exists(f"{path}/{chunkfiles.DONE}"):
        return 0.0
    began = time.perf_counter()
    known = records.select("name", "ordinal", "logical_length").orderBy("ordinal").collect()  # metadata: a row for each record
    chunks = chunk_records(records, setting.arch, setting.chunk_bases) if lines is None else pack_records(lines, setting.arch, setting.chunk_bases)
    if setting.backend == "manual":
        chunkfiles.write_store(path, chunks, setting.attributes(known), setting.compressor, True)
    else:
        arrays = []
        for component in codes.ARCHITECTURES[setting.arch]:
            suffix = component.removeprefix("2bit") if component.startswith("2bit_") else ""
            size = setting.chunk_bases // codes.bases_per_byte(component)
            arrays += [{"array": r.name + suffix, "shape": codes.encoded_length(component, r.logical_length), "chunk_bytes": size, "attributes": {"component": component}} for r in known]
        named = chunks.withColumn("array", _array_name(F.col("array"), F.col("component")))
        zarr3.write_group(path, setting.attributes(known), arrays, named, ZARR_COMPRESSORS.get(setting.compressor, setting.compressor), overwrite=True)
        files.write(f"{path}/{chunkfiles.DONE}", json.dumps({"build_seconds": time.perf_counter() - began}).encode())
    return time.perf_counter() - began


def open_build(spark: SparkSession, path: str, setting: Setting) -> DataFrame:
    """(array, component, chunk_idx, payload) of a built store, decompressed."""
    if setting.backend == "manual":
        return chunkfiles.read_store(spark, path, setting.arch, setting.compressor, setting.chunk_bases)
    attributes, arrays = zarr3.read_group(spark, path)
    if attributes.get("architecture") != ON_DISK.get(setting.arch, setting.arch):
        raise ValueError(f"a store of another architecture: {attributes.get('architecture')}")
    return zarr3.read_chunks(spark, path, arrays, setting.arch)


def _read_request(path: str, setting: Setting, chrom: str, start: int, bases: int) -> tuple[bytes, float, float]:
    """(encoded bytes that cover the window, seconds of reading, seconds of decompression)."""
    out, reading, unpacking = [], 0.0, 0.0
    unpack = decompressor(setting.compressor if setting.backend == "manual" else ZARR_COMPRESSORS.get(setting.compressor, setting.compressor))
    for component in codes.ARCHITECTURES[setting.arch]:
        per = codes.bases_per_byte(component)
        size, first, end = setting.chunk_bases // per, start // per, -(-(start + bases) // per)
        suffix = component.removeprefix("2bit") if component.startswith("2bit_") else ""
        for i in range(first // size, (end - 1) // size + 1):
            name = f"c/{chrom}{suffix}_{i}" if setting.backend == "manual" else f"{chrom}{suffix}/c/{i}"
            began = time.perf_counter()
            raw = files.read(f"{path}/{name}")
            reading += time.perf_counter() - began
            began = time.perf_counter()
            data = unpack(raw, size) if raw is not None else b""
            unpacking += time.perf_counter() - began
            out.append(data[max(0, first - i * size) : max(0, end - i * size)])
    if setting.backend == "zarr":  # one step of the backend: not told apart
        reading, unpacking = reading + unpacking, 0.0
    return b"".join(out), reading, unpacking


def timed_requests(requests: DataFrame, path: str, setting: Setting) -> DataFrame:
    """(req_id, bases, payload, seconds, read_seconds, decompress_seconds): every request read on its own, on the executors."""
    ship(requests.sparkSession)

    def run(it):
        for b in it:
            rows = []
            for req, chrom, start, bases in zip(*(b.column(c).to_pylist() for c in ("req_id", "chrom", "start", "bases"))):
                began = time.perf_counter()
                data, reading, unpacking = _read_request(path, setting, chrom, start, bases)
                rows.append((req, bases, data, time.perf_counter() - began, reading, unpacking))
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["req_id", "bases", "payload", "seconds", "read_seconds", "decompress_seconds"])

    return requests.select("req_id", "chrom", "start", "bases").mapInArrow(run, "req_id long, bases long, payload binary, seconds double, read_seconds double, decompress_seconds double")


def benchmark(requests: DataFrame, path: str, setting: Setting, warmup: int = 0) -> dict:
    """Throughput over the wall time, latencies of single requests, and their split into reading and decompression."""
    if warmup:
        timed_requests(requests.orderBy("req_id").limit(warmup), path, setting).write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    split = [F.avg(F.col(f"{k}_seconds") * 1000).alias(f"avg_{k}_latency_ms") for k in ("read", "decompress")]
    r = timed_requests(requests, path, setting).agg(F.sum("bases").alias("bases"), *metrics.latency(F.col("seconds")), *split).first().asDict()
    wall = time.perf_counter() - began
    return {"throughput_mib_s": (r.pop("bases") or 0) / (1 << 20) / wall, **r, "wall_seconds": wall}


def build_dataset(spark: SparkSession, options, window: int):
    """(reader of requests into samples, label, detail) of the dataset that the options name."""
    kind = metrics.dataset_type(options.dataset_type)
    if kind == "zarr":
        path = options.store_path or options.dir_zarr
        if not path:
            raise ValueError("a Zarr dataset needs a store")
        attributes, arrays = zarr3.open_any(spark, path, options.chrom)
        known = path.rstrip("/").split("/")
        arch = attributes.get("architecture", known[-3] if len(known) >= 3 else "uint8")
        arch = {v: k for k, v in ON_DISK.items()}.get(arch, arch)
        bases, compressor, chunk = int(attributes.get("logical_chunk_bases", 1 << 20)), attributes.get("compressor", known[-1].removesuffix(".zarr")), attributes.get("chunk_name", known[-2] if len(known) >= 2 else "")
        chunks = zarr3.read_chunks(spark, path, arrays, arch)
        detail = f"Zarr store {path}"
    else:
        path, arch = (options.dir_4bit, "4bit") if kind == "4bit" else (options.dir_2bit, "2bit")
        root = path.rstrip("/").removesuffix("/c")
        attributes = json.loads(files.read(f"{root}/zarr.json") or b"{}").get("attributes", {})
        bases, compressor, chunk = int(attributes.get("logical_chunk_bases", 1 << 20)), attributes.get("compressor", options.compressor), attributes.get("chunk_name", root.split("/")[-1])
        chunks = chunkfiles.read_store(spark, root, arch, compressor, bases)
        detail = f"{kind} chunk folder {path}"

    def read(requests: DataFrame) -> DataFrame:
        return windows.read_samples(chunks, requests.withColumn("bases", F.lit(window)), arch, bases)

    return read, f"{kind} [arch: {arch}, compressor: {compressor}, chunk: {chunk}]", detail
