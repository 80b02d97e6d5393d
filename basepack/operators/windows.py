"""Window reads: all requests at once, as an equi-join of chunk keys.

A request becomes one row for each chunk that it overlaps, joins those on (array, component,
chunk_idx), clips its part of each, and the parts are put together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, columns


def _overlaps(requests: DataFrame, component: str, chunk_bases: int) -> DataFrame:
    """One row for each chunk of each request, with the byte range [first_byte, end_byte) of the window."""
    per = codes.bases_per_byte(component)
    size = chunk_bases // per
    first, end = F.floor(F.col("start") / per), F.floor((F.col("start") + F.col("bases") + (per - 1)) / per)
    rows = requests.where("bases > 0").select("req_id", F.col("chrom").alias("array"), F.lit(component).alias("component"), first.alias("first_byte"), end.alias("end_byte"))
    return rows.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("first_byte") / size), F.floor((F.col("end_byte") - 1) / size))))


def _joined(pieces: Column) -> Column:
    ordered = F.transform(F.array_sort(pieces), lambda x: x["piece"])
    return F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p))


def read_encoded(chunks: DataFrame, requests: DataFrame, component: str, chunk_bases: int, compressor: str = "none", single_chunk: bool = False) -> DataFrame:
    """(req_id, payload): the encoded bytes that cover each window, without decoding or trimming.

    Only chunks that some request needs are decompressed, each once.  ``single_chunk`` reads the
    first chunk of a window only, and so cuts windows at its edge.  A window past an array's end is
    cut there; a request for an array without chunks gives no row.
    """
    size = chunk_bases // codes.bases_per_byte(component)
    parts = _overlaps(requests, component, chunk_bases)
    if single_chunk:
        parts = parts.where(F.col("chunk_idx") == F.floor(F.col("first_byte") / size))
    keys = ["array", "component", "chunk_idx"]
    held = chunks.where(F.col("component") == component)
    if compressor != "none":
        held = held.join(parts.select(*keys).distinct(), keys, "left_semi").withColumn("payload", columns.decompress(F.col("payload"), F.lit(size), compressor))
    base = F.col("chunk_idx") * size
    lo = F.greatest(F.lit(0), F.col("first_byte") - base).cast("int")
    hi = F.least(F.octet_length("payload").cast("long"), F.col("end_byte") - base).cast("int")
    piece = F.substring(F.col("payload"), lo + 1, F.greatest(F.lit(0), hi - lo))
    clipped = parts.join(held, keys).select("req_id", "chunk_idx", piece.alias("piece"))
    return clipped.groupBy("req_id").agg(_joined(F.collect_list(F.struct("chunk_idx", "piece"))).alias("payload"))


def read_windows(chunks: DataFrame, requests: DataFrame, arch: str, chunk_bases: int, compressor: str = "none", single_chunk: bool = False) -> DataFrame:
    """(req_id, payload), components after one another as they are in ``ARCHITECTURES``."""
    found = None
    for i, component in enumerate(codes.ARCHITECTURES[arch]):
        part = read_encoded(chunks, requests, component, chunk_bases, compressor, single_chunk).withColumnRenamed("payload", f"p{i}")
        found = part if found is None else found.join(part, "req_id")
    return found.select("req_id", F.concat(*(c for c in found.columns if c != "req_id")).alias("payload"))


def read_samples(chunks: DataFrame, requests: DataFrame, arch: str, chunk_bases: int, compressor: str = "none") -> DataFrame:
    """Decoded codes of each window, from its first base: (req_id, sequence) or, for two-bit stores, (req_id, sequence, flag)."""
    names = ["sequence", "flag"]
    found = requests.select("req_id", "start", "bases")
    for name, component in zip(names, codes.ARCHITECTURES[arch]):
        per = codes.bases_per_byte(component)
        part = read_encoded(chunks, requests, component, chunk_bases, compressor)
        found = found.join(part, "req_id").withColumn(name, columns.unpack(F.col("payload"), component, F.pmod("start", F.lit(per)), F.col("bases"))).drop("payload")
    return found.drop("start", "bases")


def window_count(length: Column, window: int) -> Column:
    return F.greatest(F.lit(0), length - window + 1)


def sliding_windows(records: DataFrame, window: int, step: int = 1) -> DataFrame:
    """A request for each window start of each record; ``start`` begins at 0."""
    n = window_count(F.col("logical_length"), window)
    rows = records.where(n > 0).select(F.col("name").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))).alias("start"))
    return rows.withColumn("bases", F.lit(window))
