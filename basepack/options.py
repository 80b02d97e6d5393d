"""Options of the two benchmarks: names and defaults are a fixed surface."""

from __future__ import annotations

import argparse

_STORES = "./zarr_compression_benchmark/stores"
#: (name, default, number of values or None for a switch)
STORE_BENCHMARK = (
    ("fasta", "./hg38_data/hg38.fa", 1),
    ("output-dir", "./hg38_benchmark_data/compressed_zarr_benchmark", 1),
    ("chromosomes", ["chr1"], "+"),
    ("backends", ["manual"], "+"),
    ("architectures", ["uint8", "4bit", "2bit_flag"], "+"),
    ("chunk-sizes", ["128KB", "256KB", "512KB", "1MB", "2MB", "4MB", "16MB"], "+"),
    ("compressors", ["none", "zlib", "gzip", "bz2", "lzma", "lz4", "zstd"], "+"),
    ("num-requests", 2000, 1),
    ("window-bases", 4096, 1),
    ("warmup", 0, 1),
    ("iterations", 1, 1),
    ("seed", 42, 1),
    ("keep-page-cache", False, None),
    ("build-only", False, None),
    ("benchmark-only", False, None),
    ("force-rebuild", False, None),
    ("no-plots", False, None),
)
DATASET_BENCHMARK = (
    ("dataset-type", "4bit", 1),
    ("window-size", 4096, 1),
    ("batch-size", 128, 1),
    ("num-workers", 16, 1),
    ("num-batches", 5000, 1),
    ("compressor", "none", 1),
    ("dir-zarr", f"{_STORES}/zarr/uint8/1MB/zstd.zarr", 1),
    ("dir-4bit", f"{_STORES}/4bit/1MB/c", 1),
    ("dir-2bit", f"{_STORES}/2bit_flag/1MB/c", 1),
    ("output-dir", "dataloader_benchmark", 1),
    ("profile-4bit", False, None),
    ("profile-4bit-samples", 5, 1),
    ("store-path", None, 1),
    ("chrom", None, 1),
)
CHOICES = {"backends": ("manual", "zarr"), "architectures": ("uint8", "4bit", "2bit_flag")}


def parse(table: tuple, argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser()
    for name, default, values in table:
        if values is None:
            parser.add_argument(f"--{name}", action="store_true")
        else:
            kind = int if isinstance(default, int) else str
            parser.add_argument(f"--{name}", default=default, type=kind, choices=CHOICES.get(name), nargs="+" if values == "+" else None)
    return parser.parse_args(argv)
