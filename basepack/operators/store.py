"""Genome stores: FASTA into packed, chunked, compressed groups; transcoding; statistics."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, columns
from ..sources import fasta, files, zarr3
from ..workspace import ship
from .chunks import CHUNK_BASES, missing_chunks

#: Group attributes that mark a store; fixed values.
SCHEMA = "genome-zarr-4bit"
SCHEMA_VERSION = 1
ARCHITECTURE = "4bit"
#: Of an array, and of a group; fixed values, as are the names of the codes.
ARRAY_ENCODING = "4bit"
GROUP_ENCODING = "two 4-bit base codes per uint8; first base is high nibble"
BASE_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "N_or_unknown": 4}


#: Folders of the legacy layout; fixed values.
LEGACY_FOLDERS = {"uint8": "uint8", "legacy_uint8": "uint8", "4bit": "4bit", "legacy_4bit": "4bit", "2bit_seq": "2bit_flag_seq", "2bit_flag": "2bit_flag_flag", "legacy_2bit_seq": "2bit_flag_seq", "legacy_2bit_flag": "2bit_flag_flag"}


def group_attributes(chunk_bases: int, compressor: str) -> dict:
    return {"schema": SCHEMA, "schema_version": SCHEMA_VERSION, "architecture": ARCHITECTURE, "encoding": GROUP_ENCODING, "base_codes": BASE_CODES, "logical_chunk_bases": chunk_bases, "compressor": compressor}


def _cut_lines(lines: DataFrame, chunk_bases: int) -> DataFrame:
    """(name, chunk_idx, t): texts of chunks.  Lines are cut at the chunks' borders, within the row, and meet by (record, chunk): the largest group is a chunk."""
    start, n = F.col("position"), F.length("line")
    first, last = F.floor(start / chunk_bases), F.floor((start + n - 1) / chunk_bases)

    def piece(k):
        lo, hi = F.greatest(start, k * chunk_bases), F.least(start + n, (k + 1) * chunk_bases)
        return F.struct(k.alias("chunk_idx"), lo.alias("at"), F.col("line").substr((lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))

    cut = lines.where(n > 0).select("name", F.explode(F.transform(F.sequence(first, last), piece)).alias("c")).select("name", "c.*")
    groups = cut.groupBy("name", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return groups.select("name", "chunk_idx", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("t"))


def pack_lines(lines: DataFrame, component: str = "4bit", chunk_bases: int = CHUNK_BASES) -> DataFrame:
    """(array, component, chunk_idx, bases, payload) from lines with base positions."""
    whole = _cut_lines(lines, chunk_bases).select(F.col("name").alias("array"), F.lit(component).alias("component"), "chunk_idx", "t")
    return whole.select("array", "component", "chunk_idx", F.length("t").cast("long").alias("bases"), columns.encode(F.col("t"), component).alias("payload"))


def pack_records(lines: DataFrame, arch: str, chunk_bases: int = CHUNK_BASES) -> DataFrame:
    """(array, component, chunk_idx, payload) of all components, as ``chunk_records`` gives them of whole sequences."""
    whole = _cut_lines(lines, chunk_bases)
    out = None
    for component in codes.ARCHITECTURES[arch]:
        part = whole.select(F.col("name").alias("array"), F.lit(component).alias("component"), "chunk_idx", columns.encode(F.col("t"), component).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def fasta_to_zstd(spark: SparkSession, fasta_path: str, destination: str, *, chunk_bases: int = CHUNK_BASES, zstd_level: int = 3, overwrite: bool = False) -> str:
    """All checks come before the destination is touched, which is replaced when the store is complete."""
    if chunk_bases <= 0 or chunk_bases % 2:
        raise ValueError("chunk_bases must be positive and even")
    if not files.exists(fasta_path):
        raise FileNotFoundError(fasta_path)
    files.prepare_destination(destination, overwrite)
    found = fasta.records(spark, fasta_path).orderBy("ordinal").collect()  # metadata: a row for each record
    chunks = pack_lines(fasta.read_fasta(spark, fasta_path), "4bit", chunk_bases)
    arrays = []
    for r in found:
        shape = codes.encoded_length("4bit", r.logical_length)
        arrays.append({"array": r.name, "shape": shape, "chunk_bytes": max(1, min(shape, chunk_bases // 2)), "attributes": {"logical_length": r.logical_length, "encoding": ARRAY_ENCODING}})
    return zarr3.write_group(destination, group_attributes(chunk_bases, "zstd"), arrays, chunks, "zstd", zstd_level, overwrite)


def open_store(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    attributes, arrays = zarr3.read_group(spark, root)
    if attributes.get("schema") != SCHEMA or attributes.get("architecture") != ARCHITECTURE:
        raise ValueError(f"not a packed genome store: {root}")
    if arrays.isEmpty():
        raise ValueError(f"store has no arrays: {root}")
    return attributes, arrays


def _transcode(spark: SparkSession, source: str, destination: str, compressor: str, overwrite: bool, level: int | None = None) -> str:
    """Copies content and attributes, all but the compressor.  Paths may not hold one another."""
    a, b = (os.path.normpath(urlparse(x).path) + "/" for x in (source, destination))
    if not files.exists(source):
        raise FileNotFoundError(source)
    if a.startswith(b) or b.startswith(a):
        raise ValueError("source and destination overlap")
    attributes, arrays = open_store(spark, source)
    files.prepare_destination(destination, overwrite)
    rows = [{"array": r.array, "shape": r.shape, "chunk_bytes": r.chunk_bytes, "attributes": json.loads(r.attributes)} for r in arrays.collect()]  # metadata
    return zarr3.write_group(destination, attributes | {"compressor": compressor}, rows, zarr3.read_chunks(spark, source, arrays), compressor, level, overwrite)


def decompress_zarr(spark: SparkSession, source: str, destination: str, *, overwrite: bool = False) -> str:
    return _transcode(spark, source, destination, "none", overwrite)


def compress_zarr(spark: SparkSession, source: str, destination: str, *, zstd_level: int = 3, overwrite: bool = False) -> str:
    return _transcode(spark, source, destination, "zstd", overwrite, zstd_level)


def store_statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row: chromosomes, logical_bases, packed_bytes, apparent_bytes, allocated_bytes, compressor, zarr_format.

    An array without a logical length counts two bases a byte; allocated bytes are of local files only.
    """
    attributes, arrays = open_store(spark, root)
    logical = F.coalesce(F.get_json_object("attributes", "$.logical_length").cast("long"), F.col("shape") * 2)
    data = arrays.agg(F.count("*").alias("chromosomes"), F.sum(logical).alias("logical_bases"), F.sum("shape").alias("packed_bytes"))
    ship(spark)
    base = urlparse(root).path if urlparse(root).scheme in ("", "file") else None

    def allocated(it):
        for b in it:
            sizes = [os.stat(f"{base}/{p}").st_blocks * 512 if base else None for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict({"length": b.column("length"), "allocated": pa.array(sizes, pa.int64())})

    used = files.listing(spark, root).mapInArrow(allocated, "length long, allocated long").agg(F.sum("length").alias("apparent_bytes"), F.sum("allocated").alias("allocated_bytes"))
    compressor = F.lit(attributes.get("compressor", "unknown"))
    return data.withColumns({"apparent_bytes": used.select("apparent_bytes").scalar(), "allocated_bytes": used.select("allocated_bytes").scalar(), "compressor": compressor, "zarr_format": F.lit(3)})


def legacy_chunks(records: DataFrame, arch: str, chunk_bases: int, existing: DataFrame | None = None) -> DataFrame:
    """Chunks of the legacy layout: bases are cut first, each piece is encoded and padded to sectors.

    ``existing``: (array, component, chunk_idx) that are there already and are left out.
    """
    n = F.ceil(F.length("seq") / F.lit(chunk_bases)).cast("int")
    # Cut within the row, so that no row carries more than its own piece behind the explode.
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.col("seq").substr(i * chunk_bases + 1, F.lit(chunk_bases)).alias("s")))
    pieces = records.where(F.length("seq") > 0).select(F.col("name").alias("array"), F.explode(cut).alias("c")).select("array", F.col("c.i").cast("long").alias("chunk_idx"), "c.s")
    out = None
    for component in codes.ARCHITECTURES[arch]:
        part = pieces.withColumn("component", F.lit(component))
        if existing is not None:
            part = missing_chunks(part, existing, ["array", "component", "chunk_idx"])
        part = part.select("array", "component", "chunk_idx", columns.padded(columns.encode(F.col("s"), component)).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def write_legacy(records: DataFrame, root: str, arch: str, chunk_bases: int, size_label: str) -> dict:
    """The legacy layout on disk: ``mmap_data/<folder>/<name>.bin``, a whole record padded to sectors, and
    ``zarr_data/<folder>_<size>.zarr/c/<name>_<i>``; what is there already is not written again.

    Records whose names begin with ``chr`` only.  Gives the numbers of files written.
    """
    spark = records.sparkSession
    ship(spark)
    some = fasta.with_prefix(records, "chr")

    def put(it):
        for b in it:
            n = 0
            for path, payload in zip(b.column("path").to_pylist(), b.column("payload").to_pylist()):
                if not files.exists(path):
                    files.write(path, payload)
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]})

    written = {"flat": 0, "chunks": 0}
    for component in codes.ARCHITECTURES[arch]:
        folder = LEGACY_FOLDERS[component]
        flat = some.where(F.length("seq") > 0).select(F.concat(F.lit(f"{root}/mmap_data/{folder}/"), F.col("name"), F.lit(".bin")).alias("path"), columns.padded(columns.encode(F.col("seq"), component)).alias("payload"))
        rows = legacy_chunks(some, arch, chunk_bases).where(F.col("component") == component)
        chunk = rows.select(F.concat(F.lit(f"{root}/zarr_data/{folder}_{size_label}.zarr/c/"), F.col("array"), F.lit("_"), F.col("chunk_idx").cast("string")).alias("path"), "payload")
        written["flat"] += flat.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
        written["chunks"] += chunk.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
    return written
