"""Command line: fasta-to-zstd, decompress, compress."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns
from .operators import store


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="basepack")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("fasta-to-zstd", "decompress", "compress"):
        command = commands.add_parser(name)
        command.add_argument("source")
        command.add_argument("destination")
        command.add_argument("--overwrite", action="store_true")
        if name != "decompress":
            command.add_argument("--zstd-level", type=int, default=3)
        if name == "fasta-to-zstd":
            command.add_argument("--chunk-bases", type=int, default=store.CHUNK_BASES)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("basepack").getOrCreate()
    began = time.perf_counter()
    print(f"Starting {args.command}: {args.source}", flush=True)
    try:
        if args.command == "fasta-to-zstd":
            store.fasta_to_zstd(spark, args.source, args.destination, chunk_bases=args.chunk_bases, zstd_level=args.zstd_level, overwrite=args.overwrite)
        elif args.command == "compress":
            store.compress_zarr(spark, args.source, args.destination, zstd_level=args.zstd_level, overwrite=args.overwrite)
        else:
            store.decompress_zarr(spark, args.source, args.destination, overwrite=args.overwrite)
    except (OSError, RuntimeError, ValueError) as error:  # what a refused path, a bad file or a bad setting raises here
        parser.error(str(error))
    took = time.perf_counter() - began
    out = _described(store.store_statistics(spark, args.destination), took)
    lines = [f"Completed: {args.command}", f"Source: {args.source}", f"Destination: {args.destination}", f"Elapsed: {out['elapsed']} ({took:.3f} seconds)", f"Chromosomes: {out['chromosomes']:,}", f"Logical bases: {out['logical_bases']:,}"]
    lines += [f"Packed 4-bit data: {out['packed']}", f"Zarr format: {out['zarr_format']}", f"Compression: {out['compressor']}", f"Destination apparent size: {out['apparent']}", f"Destination allocated size: {out['allocated']}"]
    if args.command != "fasta-to-zstd":
        source = _described(store.store_statistics(spark, args.source), took)
        lines += [f"Source Zarr format: {source['zarr_format']}", f"Source apparent size: {source['apparent']}"]
    print("\n".join(lines))


def _described(stats: DataFrame, took: float) -> dict:
    sizes = {"packed": "packed_bytes", "apparent": "apparent_bytes", "allocated": "allocated_bytes"}
    return stats.select("*", columns.format_duration(F.lit(took)).alias("elapsed"), *(columns.format_bytes(F.coalesce(c, F.lit(0))).alias(n) for n, c in sizes.items())).first().asDict()


if __name__ == "__main__":
    main()
