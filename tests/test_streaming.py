from basepack.operators.chunks import chunk_records
from basepack.streaming import ingest


def test_chunks_as_files_arrive(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "ACGT" * 30), ("b", "TTANé"), ("c", "")], "name string, seq string")
    rows.write.parquet(source)
    ingest.write(ingest.chunks(ingest.read(spark, source), "4bit", 16), out, str(tmp_path / "state")).awaitTermination()
    more = spark.createDataFrame([("d", "GG")], "name string, seq string")
    more.write.mode("append").parquet(source)
    ingest.write(ingest.chunks(ingest.read(spark, source), "4bit", 16), out, str(tmp_path / "state")).awaitTermination()
    expected = chunk_records(rows.union(more), "4bit", 16, on_non_ascii="N")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, expected.collect()))
