"""Columns: Arrow UDFs over the kernels, and formatting and arithmetic inside Catalyst."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codes
from .compress import compressor, decompressor

_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def encode(text: Column, component: str, on_non_ascii: str = "error") -> Column:
    """Packed bytes of one component of a text of bases; null stays null."""

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else codes.encode(codes.ascii_bytes(t, on_non_ascii), component) for t in x.to_pylist()], pa.binary())

    return run(text)


def decode_4bit(payload: Column, logical_length: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(x: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if p is None or k is None else codes.decode_4bit(p, k) for p, k in zip(x.to_pylist(), n.to_pylist())], pa.string())

    return run(payload, logical_length)


def unpack(payload: Column, component: str, start: Column, count: Column) -> Column:
    """Codes of ``count`` bases behind the first ``start`` of the payload."""
    bits = codes.COMPONENTS[component][1]

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def run(x: pa.Array, s: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if p is None else codes.unpack(p, bits, i, k).astype("int8") for p, i, k in zip(x.to_pylist(), s.to_pylist(), n.to_pylist())], pa.list_(pa.int8()))

    return run(payload, start, count)


def compress(payload: Column, name: str, level: int | None = None) -> Column:
    compressor(name, level)

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        f = compressor(name, level)
        return pa.array([None if p is None else f(p) for p in x.to_pylist()], pa.binary())

    return payload if name == "none" else run(payload)


def decompress(payload: Column, size: Column, name: str) -> Column:
    decompressor(name)

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array, n: pa.Array) -> pa.Array:
        f = decompressor(name)
        return pa.array([None if p is None else f(p, k) for p, k in zip(x.to_pylist(), n.to_pylist())], pa.binary())

    return payload if name == "none" else run(payload, size)


def register(spark: SparkSession) -> None:
    """Names for SQL: encode_<component>(text), with other characters than ASCII as N, and decode_4bit(payload, bases)."""

    def named(component):
        @F.arrow_udf(T.BinaryType())
        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if t is None else codes.encode(codes.ascii_bytes(t, "N"), component) for t in x.to_pylist()], pa.binary())

        return run

    for component in codes.COMPONENTS:
        spark.udf.register(f"encode_{component}", named(component))

    @F.arrow_udf(T.StringType())
    def decode(x: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if p is None else codes.decode_4bit(p, k) for p, k in zip(x.to_pylist(), n.to_pylist())], pa.string())

    spark.udf.register("decode_4bit", decode)


def encoded_length(bases: Column, component: str) -> Column:
    per = codes.bases_per_byte(component)
    return F.floor((bases + (per - 1)) / per).cast("long") if per > 1 else bases.cast("long")


def padded(payload: Column, sector: int = codes.SECTOR) -> Column:
    """With zeros to a multiple of ``sector`` bytes."""
    n = F.octet_length(payload)
    zeros = F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(sector))))
    return F.concat(payload, zeros)


def aligned(start: Column, length: Column, sector: int = codes.SECTOR) -> tuple[Column, Column, Column]:
    """(start, offset within, length) of the whole sectors that cover a range of bytes."""
    offset = F.pmod(start, F.lit(sector))
    return start - offset, offset, F.floor((offset + length + (sector - 1)) / sector).cast("long") * sector


def parse_size(label: Column) -> tuple[Column, Column]:
    """(canonical label, bytes) of sizes such as 1MB, 128kb or 64, by 1024; null if it is none."""
    text = F.upper(F.trim(label))
    pattern = r"^([0-9]+)([KMG]?B)?$"
    digits, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1).cast("long")
    number = F.when(digits != "", digits).cast("long")
    return F.concat(number.cast("string"), F.when(unit == "B", "").otherwise(unit)), number * factor


def format_bytes(n: Column, largest: str = _UNITS[-1]) -> Column:
    """Two decimals of a whole number, ties to even, and the largest unit, up to ``largest``, of which there is at least one."""
    n = n.cast("double").cast("long")
    out = F.concat(n.cast("string"), F.lit(f".00 {_UNITS[0]}"))
    for i, unit in enumerate(_UNITS[1 : _UNITS.index(largest) + 1], 1):
        # In whole numbers: a double close to a tie is rounded by its shortest digits, not by what it is.
        k = 10 * i
        part = n.bitwiseAND(F.lit((1 << k) - 1).cast("long")) * 100
        cents, rest, half = F.shiftright(part, k), part.bitwiseAND(F.lit((1 << k) - 1).cast("long")), F.lit(1 << (k - 1))
        up = (rest > half) | ((rest == half) & (cents % 2 == 1))
        cents = cents + up.cast("long")  # 100 of them carry over
        out = F.when(n >= (1 << k), F.format_string(f"%d.%02d {unit}", F.shiftright(n, k) + (cents == 100).cast("long"), cents % 100)).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS.ss"""
    s = seconds.cast("double")
    hours = F.floor(s / 3600)
    minutes = F.floor((s - hours * 3600) / 60)
    return F.format_string("%02d:%02d:%05.2f", hours, minutes, s - hours * 3600 - minutes * 60)


def chunk_name(array: Column, component: Column, idx: Column) -> Column:
    """Of a chunk's file: the component is named for two-bit stores only."""
    part = F.when(component.endswith("_seq"), "seq").when(component.endswith("_flag"), "flag")
    return F.concat_ws("_", array, part, idx.cast("string"))


def store_path(root: str, backend: str, arch: str, chunk: str, compressor_name: str) -> str:
    """Stores of the manual backend stand one level higher than others."""
    top = f"{root}/stores" if backend == "manual" else f"{root}/stores/{backend}"
    return f"{top}/{arch}/{chunk}/{compressor_name}.zarr"
