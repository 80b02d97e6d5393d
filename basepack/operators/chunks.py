"""Chunks of packed arrays: cutting, geometry, prefix sums and pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, columns

CHUNK_BASES = 1 << 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a column used inside a lambda is else computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_payload(payload: Column, chunk_bytes: int) -> Column:
    """Array of pieces of ``chunk_bytes``, the last one shorter; none of an empty payload."""

    def cut(p: Column) -> Column:
        n = F.ceil(F.octet_length(p) / F.lit(chunk_bytes)).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(p, i * chunk_bytes + 1, F.lit(chunk_bytes)))

    return let(payload, cut)


def chunk_records(records: DataFrame, arch: str, chunk_bases: int = CHUNK_BASES, name: str = "name", seq: str = "seq", on_non_ascii: str = "error") -> DataFrame:
    """(array, component, chunk_idx, payload) of whole-sequence rows: encoded, then cut.

    For records that fit in a row; ``store.pack_lines`` takes those that don't.
    """
    out = None
    for component in codes.ARCHITECTURES[arch]:
        size = chunk_bases // codes.bases_per_byte(component)
        packed = records.select(F.col(name).cast("string").alias("array"), F.lit(component).alias("component"), columns.encode(F.col(seq), component, on_non_ascii).alias("p"))
        part = packed.select("array", "component", F.posexplode(split_payload(F.col("p"), size)).alias("i", "payload"))
        part = part.select("array", "component", F.col("i").cast("long").alias("chunk_idx"), "payload")
        out = part if out is None else out.unionByName(part)
    return out


def chunk_starts(chunks: DataFrame, size: Column, by: list[str], order: Column | None = None) -> DataFrame:
    """``chunk_start``: sum of the sizes of the chunks before, in numeric order by default."""
    w = Window.partitionBy(*by).orderBy(F.col("chunk_idx") if order is None else order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("chunk_size", size).withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(w), F.lit(0)))


def running_sum(rows: DataFrame, by: str, order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``name``: sum of ``value`` in the rows before, by the whole number ``order``; in blocks of it, so that no task sorts a whole group."""
    cut = F.floor(F.col(order) / block).alias("block")
    totals = rows.groupBy(by, cut).agg(F.sum(value).alias("total"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "block", F.coalesce(F.sum("total").over(before(by, "block")), F.lit(0)).alias("base"))
    inside = rows.withColumn("block", cut).withColumn("inside", F.coalesce(F.sum(value).over(before(by, "block", order)), F.lit(0)))
    return inside.join(totals, [by, "block"]).withColumn(name, F.col("base") + F.col("inside")).drop("block", "base", "inside")


def lexicographic() -> Column:
    """Order of chunk files by name, in which 10 comes before 2."""
    return F.concat_ws("_", "array", F.col("chunk_idx").cast("string"))


def paired(seq: DataFrame, flag: DataFrame) -> DataFrame:
    """Two-bit chunks with their flags; ``bases`` is what both hold.  A chunk without a partner is left out."""
    s = seq.select("array", "chunk_idx", F.col("payload").alias("seq"))
    f = flag.select("array", "chunk_idx", F.col("payload").alias("flag"))
    both = s.join(f, ["array", "chunk_idx"])
    return both.withColumn("bases", F.least(F.octet_length("seq").cast("long") * 4, F.octet_length("flag").cast("long") * 8))


def asof_chunk(starts: DataFrame, lookups: DataFrame, by: str = "array", cell: int = CHUNK_BASES) -> DataFrame:
    """For each (lookup ``at``) the chunk with the greatest chunk_start <= at, for chunks of any sizes.

    Both sides meet in cells of ``cell``: a chunk is in each cell that it reaches, a lookup in one.
    A lookup past the end finds nothing.
    """
    last = F.greatest(F.col("chunk_start"), F.col("chunk_start") + F.col("chunk_size") - 1)
    cells = starts.where("chunk_size > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("chunk_start") / cell), F.floor(last / cell))))
    at = lookups.withColumn("cell", F.floor(F.col("at") / cell))
    return at.join(cells, [by, "cell"]).where("at >= chunk_start and at < chunk_start + chunk_size").drop("cell")


def missing_chunks(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(existing, keys, "left_anti")


def max_elements(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("array", "component").agg(F.max(F.octet_length("payload")).cast("long").alias("max_bytes"), F.count("*").alias("chunks"))


def longest_array(records: DataFrame) -> DataFrame:
    """The longest record, the first of equals; the sort is a top-1, not a total order."""
    return records.orderBy(F.desc("logical_length"), F.asc("ordinal")).limit(1)
