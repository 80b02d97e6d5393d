import numpy as np
import pytest
from pyspark.sql import functions as F

from basepack.operators import chunks, metrics
from basepack.sources import chunkfiles


def test_percentiles(spark):
    values = [0.1, 0.5, 0.2, 0.9, 0.3]
    r = spark.createDataFrame([(v,) for v in values], "s double").agg(*metrics.latency(F.col("s"))).first()
    assert r.p95_latency_ms == pytest.approx(np.percentile(values, 95) * 1000)
    assert r.median_latency_ms == pytest.approx(300)
    none = spark.createDataFrame([], "s double").agg(*metrics.latency(F.col("s"))).first()
    assert np.isnan(none.p99_latency_ms)


def test_timed(spark):
    requests = spark.createDataFrame([(i, "a", 0, 10) for i in range(5)], "req_id long, chrom string, start long, bases int")
    got = metrics.timed(lambda r: r, requests, warm=2)
    assert got["num_requests"] == 5 and got["throughput_mib_s"] > 0
    assert metrics.timed_batches(requests, 2)["Batches_Per_Sec"] > 0
    assert metrics.timed_batches(requests.limit(0), 2)["Batches_Per_Sec"] == 0


def test_types():
    assert metrics.dataset_type("FourBit") == "4bit"
    with pytest.raises(ValueError):
        metrics.dataset_type("nope")


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    assert chunkfiles.write_results(df, str(tmp_path / "r"))
    assert chunkfiles.read_results(spark, str(tmp_path / "r"), "k string, v double").first() == ("a", 1.5)
    assert not chunkfiles.write_results(df.limit(0), str(tmp_path / "none"))


def test_order_and_asof(spark):
    df = spark.createDataFrame([("a", i) for i in (10, 2, 1)], "array string, chunk_idx long")
    assert [r.chunk_idx for r in df.orderBy(chunks.lexicographic()).collect()] == [1, 10, 2]
    starts = chunks.chunk_starts(df, F.lit(5).cast("long"), ["array"])
    at = spark.createDataFrame([("a", x) for x in (0, 4, 5, 14, 15, -1)], "array string, at long")
    got = {r.at: r.chunk_idx for r in chunks.asof_chunk(starts, at, cell=4).collect()}
    assert got == {0: 1, 4: 1, 5: 2, 14: 10}
    assert [r.chunk_idx for r in metrics.in_order(df, "chunk_idx", [2, 10]).collect()] == [2, 10, 1]


def test_format_bytes(spark):
    """The largest unit can be set; what only looks like a tie is rounded by its value."""
    from basepack.functions import columns

    values = [0, 1023, 1024, 1029, 1048575, 1 << 50, 1 << 60, 4503605124928635, 4503638110277468]
    df = spark.createDataFrame([(v,) for v in values], "n long").select(columns.format_bytes(F.col("n"), "TiB").alias("t"), columns.format_bytes(F.col("n")).alias("p"))
    t, p = zip(*df.collect())
    assert t == ("0.00 B", "1023.00 B", "1.00 KiB", "1.00 KiB", "1024.00 KiB", "1024.00 TiB", "1048576.00 TiB", "4096.01 TiB", "4096.03 TiB")
    assert p[:5] == t[:5] and p[5:] == ("1.00 PiB", "1024.00 PiB", "4.00 PiB", "4.00 PiB")
