"""Throughput, latencies, storage and the tables behind comparisons."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of encodings in stores' folder names.
ALIASES = {"zarr": "zarr", "zarrdataset": "zarr", "4bit": "4bit", "fourbit": "4bit", "fourbitdataset": "4bit", "2bit": "2bit", "twobit": "2bit", "twobitdataset": "2bit"}


def latency(seconds: Column) -> list[Column]:
    """Mean, median and linear-interpolation percentiles, in milliseconds; NaN without samples."""
    ms = seconds * 1000.0
    nan = F.lit(float("nan"))
    return [F.coalesce(c, nan).alias(f"{n}_latency_ms") for n, c in (("avg", F.avg(ms)), ("median", F.percentile(ms, F.lit(0.5))), ("p95", F.percentile(ms, F.lit(0.95))), ("p99", F.percentile(ms, F.lit(0.99))))]


def throughput(bases: Column, seconds: Column) -> Column:
    """Million (2^20) bases a second."""
    return (F.sum(bases) / float(1 << 20) / F.sum(seconds)).alias("throughput_mib_s")


def config_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of small lists of settings, from one row."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*(F.lit(v) for v in values))).alias(name))
    return out


def run_label(df: DataFrame) -> DataFrame:
    return df.withColumn("run_label", F.concat_ws(":", "backend", "compressor"))


def gib(size: Column) -> Column:
    return size / float(1 << 30)


def storage_profile(files: DataFrame) -> DataFrame:
    """Sizes by (architecture, layout) from (path, length[, allocated]); sequence and flag files of a layout add up.

    ``<arch>/<name>.bin`` is the flat layout; chunks are in ``<arch>_<size>.zarr/c``.  Folders of either
    two-bit component are architecture ``2bit_flag``.
    """
    flat = F.regexp_extract("path", r"([^/]+)/[^/]+\.bin$", 1)
    store = F.regexp_extract("path", r"([^/]+)\.zarr/c/", 1)
    words = F.split(store, "_")
    arch = F.when(flat != "", F.when(flat.contains("2bit_flag"), F.lit("2bit_flag")).otherwise(flat))
    arch = arch.otherwise(F.when(F.arrays_overlap(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), F.array(F.lit("seq"), F.lit("flag"))), F.lit("2bit_flag")).otherwise(words[0]))
    layout = F.when(flat != "", F.lit("flat")).otherwise(F.element_at(words, -1))
    rows = files.where((flat != "") | (store != "")).select(arch.alias("architecture"), layout.alias("layout"), *(c for c in ("length", "allocated") if c in files.columns))
    sums = [F.sum("length").alias("apparent_bytes"), *([F.sum("allocated").alias("physical_bytes")] if "allocated" in files.columns else []), F.count("*").alias("files")]
    return rows.groupBy("architecture", "layout").agg(*sums).orderBy("architecture", "layout")


def matching(results: DataFrame, **chosen) -> DataFrame:
    """The results that have these values; a list admits each of its values, None a null."""
    for name, value in chosen.items():
        column = F.col(name)
        results = results.where(column.isin(value) if isinstance(value, (list, tuple)) else column.eqNullSafe(F.lit(value)))
    return results


def facets(results: DataFrame, *names: str) -> DataFrame:
    """(name, value) of all distinct values of some columns, as strings; one aggregation."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names)))
    return results.select(each.alias("f")).select("f.*").distinct()


def has_breakdown(results: DataFrame, names: tuple[str, ...] = ("avg_read_latency_ms", "avg_decompress_latency_ms")) -> bool:
    """Whether all results have the split of latencies: the columns are there, without null or NaN."""
    if any(n not in results.columns for n in names):
        return False
    bad = [F.col(n).isNull() | F.isnan(F.col(n).cast("double")) for n in names]
    return results.where(bad[0] | bad[1] if len(bad) == 2 else bad[0]).isEmpty()


def first_pivot(df: DataFrame, by: str, column: str, values: list, value: str) -> DataFrame:
    """The first value of each (by, column), one column each; 0 where there is none."""
    return df.groupBy(by).pivot(column, values).agg(F.first(value, True)).fillna(0, [str(v) for v in values])


def in_order(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows in the order of a fixed list; others are last."""
    at = F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column))
    return df.orderBy(F.when(at == 0, len(values) + 1).otherwise(at), column)


def dataset_type(name: str) -> str:
    kind = ALIASES.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown dataset type: {name}")
    return kind


def timed(read: Callable[[DataFrame], DataFrame], requests: DataFrame, warm: int = 0) -> dict:
    """Wall time and throughput of reading all requests in one job, after a warm-up prefix."""
    if warm:
        read(requests.orderBy("req_id").limit(warm)).write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    read(requests).write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - began
    bases, n = requests.agg(F.sum("bases"), F.count("*")).first()
    return {"num_requests": n, "wall_seconds": wall, "throughput_mib_s": (bases or 0) / (1 << 20) / wall, "avg_latency_ms": wall * 1000 / n if n else float("nan")}


def timed_batches(samples: DataFrame, batch_size: int = 128, most: int = 500) -> dict:
    """Batches a second of a consumer on the driver that takes up to ``most`` batches in their order."""
    rows, count, total, began = samples.orderBy("req_id").toLocalIterator(prefetchPartitions=True), 0, 0.0, time.perf_counter()
    held = 0
    for _ in rows:
        held += 1
        if held == batch_size:
            held, count = 0, count + 1
            total = time.perf_counter() - began
            if count == most:
                break
    return {"Batches_Per_Sec": count / total if total else 0.0, "Avg_Latency_ms": total * 1000 / count if count else float("nan")}
