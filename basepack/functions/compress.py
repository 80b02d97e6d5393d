"""Compressors of chunks, by name.  All are lossless.

``lz4`` is the frame format; ``lz4_block`` is the block format behind its size as a little-endian
32-bit number, as Zarr's codec of that name writes it.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Callable

#: Levels are fixed values.
NAMES = ("none", "zlib", "gzip", "bz2", "lzma", "lz4", "lz4_block", "zstd")
ZSTD_LEVEL = 3


def compressor(name: str, level: int | None = None) -> Callable[[bytes], bytes]:
    if name == "none":
        return bytes
    if name == "zlib":
        return lambda x: zlib.compress(x, level or 6)
    if name == "gzip":
        return lambda x: gzip.compress(x, compresslevel=level or 6, mtime=0)
    if name == "bz2":
        return lambda x: bz2.compress(x, level or 6)
    if name == "lzma":
        return lambda x: lzma.compress(x, preset=level or 6)
    if name == "lz4":
        import pyarrow as pa

        codec = pa.Codec("lz4")
        return lambda x: codec.compress(x, asbytes=True)
    if name == "lz4_block":
        import pyarrow as pa

        block = pa.Codec("lz4_raw")
        return lambda x: len(x).to_bytes(4, "little") + block.compress(x, asbytes=True)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=ZSTD_LEVEL if level is None else level).compress
    raise ValueError(f"unknown compressor: {name}")


def decompressor(name: str) -> Callable[[bytes, int], bytes]:
    """Of a chunk and the size of what it holds."""
    plain = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}
    if name == "none":
        return lambda x, n: bytes(x)
    if name in plain:
        return lambda x, n, f=plain[name]: f(x)
    if name == "lz4":
        import pyarrow as pa

        return lambda x, n: pa.input_stream(pa.py_buffer(x), compression="lz4").read()
    if name == "lz4_block":
        import pyarrow as pa

        block = pa.Codec("lz4_raw")
        return lambda x, n: block.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True)
    if name == "zstd":
        import zstandard

        return lambda x, n: zstandard.ZstdDecompressor().decompress(x, max_output_size=n)
    raise ValueError(f"unknown compressor: {name}")
