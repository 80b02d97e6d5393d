"""Requests: reproducible random windows and batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most records and requests that the driver's generator takes.
MOST = 10_000_000
REQUESTS = "req_id long, chrom string, start long, bases int"


def eligible(records: DataFrame, window: int) -> DataFrame:
    return records.where(F.col("logical_length") > window)


def generate_requests(spark: SparkSession, records: DataFrame, n: int, window: int, seed: int = 42) -> DataFrame:
    """Length-weighted records with replacement, uniform starts in [0, length - window).

    On the driver, with one generator and one draw of each kind a request, so that a seed always
    gives the same requests; ``distributed_requests`` is for more than MOST of them.
    """
    rows = eligible(records, window).select("name", "logical_length").orderBy("ordinal").take(MOST + 1)
    if not rows:
        raise ValueError("no record is longer than the window")
    if len(rows) > MOST or n > MOST:
        raise ValueError("too many for the driver: use distributed_requests")
    lengths = np.array([r.logical_length for r in rows])
    rng = np.random.RandomState(seed)
    picked = rng.choice(len(rows), size=n, p=lengths / lengths.sum())
    starts = [int(rng.randint(0, lengths[i] - window)) for i in picked]
    return spark.createDataFrame([(k, rows[i].name, s, window) for k, (i, s) in enumerate(zip(picked, starts))], REQUESTS)


def distributed_requests(spark: SparkSession, records: DataFrame, n: int, window: int, seed: int = 42) -> DataFrame:
    """The same distribution from hashes of the request's number, for any number of records and requests.

    Every record gets a stretch of the line of all lengths, cut into cells; a request falls on a
    point of the line, and its cell says which records can hold it.
    """
    from pyspark.sql import Window

    some = eligible(records, window)
    starts = some.withColumn("line", F.coalesce(F.sum("logical_length").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = some.agg(F.sum("logical_length")).first()[0]
    if not total:
        raise ValueError("no record is longer than the window")
    cell = max(1, total // 4096)
    cells = starts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("line") / cell), F.floor((F.col("line") + F.col("logical_length") - 1) / cell))))
    draw = lambda salt, most: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), most)
    points = spark.range(n).withColumn("point", draw(1, F.lit(total))).withColumn("cell", F.floor(F.col("point") / cell))
    hit = points.join(cells, "cell").where("point >= line and point < line + logical_length")
    return hit.select(F.col("id").alias("req_id"), F.col("name").alias("chrom"), draw(2, F.col("logical_length") - window).alias("start"), F.lit(window).alias("bases"))


def fixed_requests(spark: SparkSession, chrom: str, length: int, n: int = 2000, window: int = 4096, seed: int = 42) -> DataFrame:
    """Uniform starts in [0, length - window) of one record."""
    rng = np.random.RandomState(seed)
    return spark.createDataFrame([(k, chrom, int(s), window) for k, s in enumerate(rng.randint(0, length - window, n))], REQUESTS)


def bounded_random(spark: SparkSession, population: int, n: int, seed: int = 42) -> DataFrame:
    """(req_id, idx) with replacement; nothing if n <= 0."""
    return spark.range(max(0, n)).select(F.col("id").alias("req_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(population)).alias("idx"))


def batch_of(req_id: Column, size: int = 128) -> Column:
    return F.floor(req_id / size).cast("long")


def warmup(requests: DataFrame, n: int) -> DataFrame:
    return requests.orderBy("req_id").limit(n)
