"""Bytes of files, on any file system that pyarrow or Spark can open."""

from __future__ import annotations

import os
import posixpath
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


def write(uri: str, data: bytes) -> None:
    fs, path = opened(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def read(uri: str) -> bytes | None:
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def exists(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def folders(uri: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, path = opened(uri)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.Directory)


def allocated(uri: str) -> int | None:
    """Bytes that a local file takes on its disk; None elsewhere."""
    fs, path = opened(uri)
    return os.stat(path).st_blocks * 512 if isinstance(fs, pafs.LocalFileSystem) else None


def remove(uri: str) -> None:
    fs, path = opened(uri)
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(path)
    elif kind == pafs.FileType.File:
        fs.delete_file(path)


def move(source: str, destination: str) -> None:
    fs, path = opened(source)
    _, to = opened(destination)
    fs.create_dir(posixpath.dirname(to), recursive=True)
    fs.move(path, to)


def prepare_destination(uri: str, overwrite: bool) -> None:
    """Refuses what exists unless ``overwrite``; removes nothing: a store replaces it when it is complete."""
    if exists(uri) and not overwrite:
        raise FileExistsError(f"destination exists: {uri}")


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path relative to root, length[, content]) of all files below, scanned by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = posixpath.basename(root.rstrip("/")) + "/"
    at = F.instr("path", folder) + len(folder)
    return rows.select(F.col("path").substr(at, F.length("path")).alias("path"), "length", *(["content"] if content else []))
