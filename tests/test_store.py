import json
import os

import pytest

from basepack import cli
from basepack.functions import codes
from basepack.operators import sampling, store, windows
from basepack.sources import chunkfiles, fasta, zarr3

FASTA = ">chr1 description\nACGTN\nRY\n>chr2\nTTA\n"


@pytest.fixture
def file(tmp_path):
    def make(text, name="a.fa"):
        path = tmp_path / name
        path.write_bytes(text.encode() if isinstance(text, str) else text)
        return str(path)

    return make


def held(spark, root):
    attributes, arrays = store.open_store(spark, root)
    chunks = zarr3.read_chunks(spark, root, arrays).orderBy("array", "chunk_idx").collect()
    out = {}
    for r in chunks:
        out[r.array] = out.get(r.array, b"") + bytes(r.payload)
    return attributes, out, {r.array: json.loads(r.attributes)["logical_length"] for r in arrays.collect()}


def test_round_trip(spark, file, tmp_path):
    a, b, c = (str(tmp_path / x) for x in ("zstd", "none", "again"))
    store.fasta_to_zstd(spark, file(FASTA), a, chunk_bases=4)
    store.decompress_zarr(spark, a, b)
    store.compress_zarr(spark, b, c)
    found = [held(spark, x) for x in (a, b, c)]
    assert [f[0]["compressor"] for f in found] == ["zstd", "none", "zstd"]
    assert found[0][1] == found[1][1] == found[2][1] == {"chr1": bytes.fromhex("01234440"), "chr2": bytes.fromhex("3300")}
    assert {k: codes.decode_4bit(v, found[0][2][k]) for k, v in found[0][1].items()} == {"chr1": "ACGTNNN", "chr2": "TTA"}
    s = store.store_statistics(spark, c).first()
    assert (s.chromosomes, s.logical_bases, s.packed_bytes, s.zarr_format) == (2, 10, 6, 3)
    assert s.apparent_bytes > 0 and s.allocated_bytes > 0
    assert sorted(os.listdir(f"{a}/chr1/c")) == ["0", "1"]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_ranges(spark, file, size):
    path = file(">a x\r\nAC GT\n\n  TT \n>none\n>b\nA\nC\nG\n")
    lines = sorted(tuple(r)[0:3:2] + (r.line,) for r in fasta.read_fasta(spark, path, size=size).collect())
    assert lines == [("a", 0, "AC GT"), ("a", 5, "TT"), ("b", 0, "A"), ("b", 1, "C"), ("b", 2, "G")]
    assert sorted((r.name, r.logical_length) for r in fasta.records(spark, path, size=size).collect()) == [("a", 7), ("b", 3), ("none", 0)]


@pytest.mark.parametrize("text", ["", "\n\n", "ACGT\n>a\nA\n", ">a\nA\n>a\nC\n", ">\nA\n", ">.\nA\n", ">..\nA\n", ">a/b\nA\n", b">a\nA\xc3\xa9\n"])
def test_bad_fasta(spark, file, tmp_path, text):
    with pytest.raises(Exception):
        store.fasta_to_zstd(spark, file(text), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_permissive(spark, file):
    path = file("ACGT\n> a x\nA\n")
    assert [r.name for r in fasta.read_fasta(spark, path, permissive=True).collect()] == ["a"]


@pytest.mark.parametrize("n", [0, -2, 3])
def test_bad_chunk(spark, file, tmp_path, n):
    with pytest.raises(ValueError):
        store.fasta_to_zstd(spark, file(FASTA), str(tmp_path / "out"), chunk_bases=n)


def test_destination(spark, file, tmp_path):
    out = str(tmp_path / "out")
    store.fasta_to_zstd(spark, file(FASTA), out)
    with pytest.raises(FileExistsError):
        store.fasta_to_zstd(spark, file(FASTA), out)
    store.fasta_to_zstd(spark, file(">x\nAC\n"), out, overwrite=True)
    assert list(held(spark, out)[1]) == ["x"]
    with pytest.raises(FileNotFoundError):
        store.decompress_zarr(spark, str(tmp_path / "nothing"), str(tmp_path / "b"))
    for other in (out, str(tmp_path), f"{out}/inside"):
        with pytest.raises(ValueError):
            store.decompress_zarr(spark, out, other, overwrite=True)
    group = json.loads((tmp_path / "out/zarr.json").read_text())
    group["attributes"]["schema"] = "other"
    (tmp_path / "out/zarr.json").write_text(json.dumps(group))
    with pytest.raises(ValueError):
        store.store_statistics(spark, out).first()


def test_missing_chunk_is_zeros(spark, file, tmp_path):
    out = str(tmp_path / "out")
    store.fasta_to_zstd(spark, file(">a\nACGTACGTAC\n"), out, chunk_bases=4)
    os.remove(f"{out}/a/c/1")
    assert held(spark, out)[1]["a"].hex() == "0123000001"


def test_chromosomes(spark, file):
    path = file(FASTA)
    assert {r.name for r in fasta.select_chromosomes(spark, path, ["chr2"]).collect()} == {"chr2"}
    with pytest.raises(ValueError, match="chr8, chr9"):
        fasta.select_chromosomes(spark, path, ["chr9", "chr8", "chr1"])
    file("chr1\t70\t6\t5\nbad\nchr7\t5\n", "a.fa.fai")
    assert {(r.name, r.logical_length) for r in fasta.select_chromosomes(spark, path, ["all"]).collect()} == {("chr1", 70), ("chr7", 5)}


def test_chunk_store(spark, tmp_path):
    from basepack.operators.chunks import chunk_records

    text = "ACGTNACGGT" * 40
    rows = spark.createDataFrame([("chr1", text)], "name string, seq string")
    for arch in ("uint8", "4bit", "2bit"):
        path = str(tmp_path / f"{arch}.zarr")
        chunks = chunk_records(rows, arch, 32)
        assert chunkfiles.write_store(path, chunks, {"architecture": arch}, "zstd")
        assert not chunkfiles.write_store(path, chunks, {"architecture": arch}, "zstd")
        again = chunkfiles.read_store(spark, path, arch, "zstd", 32)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chunks.collect()))
        request = spark.createDataFrame([(1, "chr1", 13, 90)], sampling.REQUESTS)
        sample = windows.read_samples(again, request, arch, 32).first()
        base = [("ACGT".index(c) if c in "ACGT" else (0 if arch == "2bit" else 4)) for c in text[13:103]]
        assert list(sample.sequence) == base
        if arch == "2bit":
            assert list(sample.flag) == [int(c == "N") for c in text[13:103]]
        assert chunkfiles.storage_bytes(spark, path)["file_count"] == chunks.count() + 2
        assert chunkfiles.storage_bytes(spark, path)["physical_bytes"] > 0
    with pytest.raises(FileNotFoundError):
        chunkfiles.read_store(spark, str(tmp_path / "no"), "4bit", "zstd", 32)


def test_requests(spark):
    rows = spark.createDataFrame([("a", 0, 100), ("b", 1, 10_000), ("c", 2, 64)], "name string, ordinal long, logical_length long")
    one = sampling.generate_requests(spark, rows, 200, 64).collect()
    assert one == sampling.generate_requests(spark, rows, 200, 64).collect()
    far = sampling.distributed_requests(spark, rows, 500, 64).collect()
    assert len(far) == 500 and {r.chrom for r in far} <= {"a", "b"}
    size = {"a": 100, "b": 10_000}
    assert all(0 <= r.start < size[r.chrom] - 64 for r in [*one, *far])
    assert sum(r.chrom == "b" for r in far) > 450
    with pytest.raises(ValueError):
        sampling.generate_requests(spark, rows, 1, 1 << 20)
    assert sampling.bounded_random(spark, 10, 0).count() == 0


def test_cli(spark, file, tmp_path, capsys):
    out = str(tmp_path / "out")
    cli.main(["fasta-to-zstd", file(FASTA), out, "--chunk-bases", "4"])
    said = capsys.readouterr().out
    assert "Chromosomes: 2\n" in said and "Logical bases: 10\n" in said and "Packed 4-bit data: 6.00 B" in said
    cli.main(["decompress", out, str(tmp_path / "plain")])
    assert "Source apparent size: " in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["decompress", str(tmp_path / "nothing"), str(tmp_path / "b")])


def genome(spark):
    rows = [("chr1", 0, "ACGTNACGGTRY" * 30), ("chr2", 1, "TTANC"), ("other", 2, "ACGT" * 10), ("chr3", 3, "")]
    return spark.createDataFrame([(n, o, len(s), s) for n, o, s in rows], "name string, ordinal long, logical_length long, seq string")


@pytest.mark.parametrize("backend", ["manual", "zarr"])
@pytest.mark.parametrize(("arch", "compressor"), [("uint8", "zstd"), ("4bit", "lz4"), ("2bit", "none"), ("2bit", "lzma")])
def test_builds(spark, tmp_path, backend, arch, compressor):
    """Stores of either backend hold the chunks, and requests read one by one give what the join gives."""
    from basepack.operators import builds
    from basepack.operators.chunks import chunk_records

    setting, path = builds.Setting(backend, arch, "32", 32, compressor), str(tmp_path / "s.zarr")
    assert builds.build_store(genome(spark), path, setting) > 0 == builds.build_store(genome(spark), path, setting)
    again = builds.open_build(spark, path, setting)
    expected = chunk_records(genome(spark), arch, 32).where("octet_length(payload) > 0").select("array", "component", "chunk_idx", "payload")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, expected.collect()))
    requests = spark.createDataFrame([(1, "chr1", 13, 90), (2, "chr1", 0, 32), (3, "other", 31, 9), (4, "chr2", 0, 5)], sampling.REQUESTS)
    one = {r.req_id: bytes(r.payload) for r in builds.timed_requests(requests, path, setting).collect()}
    assert one == {r.req_id: bytes(r.payload) for r in windows.read_windows(expected, requests, arch, 32).collect()}
    got = builds.benchmark(requests, path, setting, warmup=2)
    assert set(got) == {"throughput_mib_s", "avg_latency_ms", "median_latency_ms", "p95_latency_ms", "p99_latency_ms", "avg_read_latency_ms", "avg_decompress_latency_ms", "wall_seconds"}
    assert got["avg_read_latency_ms"] > 0 and (got["avg_decompress_latency_ms"] == 0) == (backend == "zarr")
    with pytest.raises(ValueError):
        builds.build_store(genome(spark), path, builds.Setting("other", arch, "32", 32))


def test_datasets(spark, tmp_path):
    from basepack import options
    from basepack.operators import builds

    request = spark.createDataFrame([(1, "chr1", 3, 7)], sampling.REQUESTS)
    for kind, backend, arch, option in (("FourBitDataset", "manual", "4bit", "dir-4bit"), ("twobit", "manual", "2bit", "dir-2bit"), ("zarr", "zarr", "uint8", "store-path")):
        path = str(tmp_path / f"{arch}.zarr")
        builds.build_store(genome(spark), path, builds.Setting(backend, arch, "32", 32, "zstd"))
        chosen = options.parse(options.DATASET_BENCHMARK, ["--dataset-type", kind, f"--{option}", path + ("/c" if backend == "manual" else "")])
        read, label, detail = builds.build_dataset(spark, chosen, chosen.window_size if kind != "zarr" else 4)
        sequence = list(read(request).first().sequence)
        assert sequence[:4] == [3, 0 if arch == "2bit" else 4, 0, 1] and f"arch: {arch}, compressor: zstd, chunk: 32" in label and path in detail
    with pytest.raises(ValueError):
        builds.build_dataset(spark, options.parse(options.DATASET_BENCHMARK, ["--dataset-type", "x"]), 4)
    found = options.parse(options.STORE_BENCHMARK, ["--chunk-sizes", "1MB", "2MB", "--build-only", "--seed", "7"])
    assert found.chunk_sizes == ["1MB", "2MB"] and found.build_only and not found.no_plots and found.seed == 7 and found.num_requests == 2000


def test_bare_arrays_and_format_2(spark, tmp_path):
    from basepack.functions.compress import compressor
    from basepack.sources import files

    data = bytes(range(1, 11))
    for codec, name in ((None, "none"), ({"id": "lz4"}, "lz4_block"), ({"id": "zstd", "level": 3}, "zstd")):
        root = str(tmp_path / f"v2{name}")
        node = {"zarr_format": 2, "shape": [10], "chunks": [4], "dtype": "|u1", "compressor": codec, "fill_value": 0, "order": "C", "filters": None}
        files.write(f"{root}/.zgroup", b'{"zarr_format": 2}')
        files.write(f"{root}/.zattrs", b'{"architecture": "uint8"}')
        files.write(f"{root}/a/.zarray", json.dumps(node).encode())
        for i in (0, 2):
            files.write(f"{root}/a/{i}", compressor(name)(data[4 * i : 4 * i + 4].ljust(4, b"\0")))
        attributes, arrays = zarr3.open_any(spark, root)
        assert attributes == {"architecture": "uint8"}
        for at, chosen in ((root, "a"), (f"{root}/a", "")):
            _, arrays = zarr3.open_any(spark, at, "a" if at == root else None)
            got = zarr3.read_chunks(spark, at, arrays, "uint8").orderBy("chunk_idx").collect()
            assert [(r.array, bytes(r.payload)) for r in got] == [(chosen, data[:4]), (chosen, bytes(4)), (chosen, data[8:])]
    out = str(tmp_path / "v3")
    store.fasta_to_zstd(spark, _written(tmp_path, FASTA), out, chunk_bases=4)
    _, arrays = zarr3.open_any(spark, f"{out}/chr1")
    assert [bytes(r.payload).hex() for r in zarr3.read_chunks(spark, f"{out}/chr1", arrays).orderBy("chunk_idx").collect()] == ["0123", "4440"]
    with pytest.raises(FileNotFoundError):
        zarr3.open_any(spark, str(tmp_path))


def _written(tmp_path, text):
    (tmp_path / "w.fa").write_text(text)
    return str(tmp_path / "w.fa")


def test_packed_length_must_match(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, b"12")], "array string, chunk_idx long, payload binary")
    with pytest.raises(RuntimeError, match="a"):
        zarr3.write_group(str(tmp_path / "x"), {}, [{"array": "a", "shape": 3, "chunk_bytes": 3, "attributes": {}}], chunks, "none")
    assert not (tmp_path / "x").exists()


def test_legacy_layout(spark, tmp_path):
    """Flat files and chunks of both components; a second run writes only what is missing; sizes by architecture."""
    from basepack.operators import metrics

    root = str(tmp_path)
    assert store.write_legacy(genome(spark), root, "2bit", 64, "64B") == {"flat": 4, "chunks": 14}
    os.remove(f"{root}/zarr_data/2bit_flag_seq_64B.zarr/c/chr1_1")
    assert store.write_legacy(genome(spark), root, "2bit", 64, "64B") == {"flat": 0, "chunks": 1}
    assert os.path.getsize(f"{root}/mmap_data/2bit_flag_flag/chr1.bin") == 4096
    store.write_legacy(genome(spark), root, "legacy_4bit", 64, "64B")
    got = metrics.storage_profile(chunkfiles.sizes(spark, root)).collect()
    assert [(r.architecture, r.layout, r.files) for r in got] == [("2bit_flag", "64B", 14), ("2bit_flag", "flat", 4), ("4bit", "64B", 7), ("4bit", "flat", 2)]
    assert all(r.apparent_bytes == 4096 * r.files <= r.physical_bytes for r in got)


def test_results_filters(spark):
    from basepack.operators import metrics

    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 2, 1.0, float("nan")), (None, 2, 3.0, 4.0)], "k string, n int, avg_read_latency_ms double, avg_decompress_latency_ms double")
    assert metrics.matching(df, k=["a", "b"], n=2).count() == 1 and metrics.matching(df, k=None).count() == 1
    assert {tuple(r) for r in metrics.facets(df, "k", "n").collect()} == {("k", "a"), ("k", "b"), ("k", None), ("n", "1"), ("n", "2")}
    assert not metrics.has_breakdown(df) and metrics.has_breakdown(df.where("k = 'a'")) and not metrics.has_breakdown(df.select("k"))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_fasta_in_parts(spark, file, tmp_path, size):
    """A folder's files are one FASTA file; a record goes on in the next part, and parts are dealt over tasks."""
    (tmp_path / "parts").mkdir()
    for name, text in {"part-1": "ACG\n>b\nA\n", "part-0": ">a x\nAC\n", "part-2": "", "part-3": "TT\n>none\n", "_SUCCESS": ">no\n", ".part-0.crc": ">no\n"}.items():
        file(text, f"parts/{name}")
    path = str(tmp_path / "parts")
    lines = fasta.read_fasta(spark, path, size=size)
    assert sorted((r.name, r.position, r.line) for r in lines.collect()) == [("a", 0, "AC"), ("a", 2, "ACG"), ("b", 0, "A"), ("b", 1, "TT")]
    found = fasta.records(spark, path, size=size).orderBy("ordinal").collect()
    assert [tuple(r) for r in found] == [("a", 0, 5), ("b", 12, 3), ("none", 20, 0)]
    if size == 3:
        from pyspark.sql import functions as F

        assert lines.select(F.spark_partition_id()).distinct().count() == 4
    assert store.fasta_to_zstd(spark, path, str(tmp_path / "out"), chunk_bases=4)
    assert {k: v.hex() for k, v in held(spark, str(tmp_path / "out"))[1].items()} == {"a": "010120", "b": "0330"}


@pytest.mark.parametrize("backend", ["manual", "zarr"])
@pytest.mark.parametrize("arch", ["uint8", "4bit", "2bit"])
def test_builds_from_lines(spark, tmp_path, backend, arch):
    """A store of lines is that of whole sequences, and no row holds a whole record."""
    from basepack.operators import builds
    from basepack.operators.chunks import chunk_records

    lines = [(r.name, at, r.seq[at : at + 70]) for r in genome(spark).collect() for at in range(0, len(r.seq), 70)]
    lines = spark.createDataFrame([*lines, ("chr3", 0, "")], "name string, position long, line string")
    setting, path = builds.Setting(backend, arch, "32", 32, "zstd"), str(tmp_path / "s.zarr")
    builds.build_store(genome(spark).drop("seq"), path, setting, lines=lines)
    expected = chunk_records(genome(spark), arch, 32).where("octet_length(payload) > 0").select("array", "component", "chunk_idx", "payload")
    assert sorted(map(tuple, builds.open_build(spark, path, setting).collect())) == sorted(map(tuple, expected.collect()))


def test_sources_are_lines(spark, tmp_path):
    """A source's documents stay rows of their own; texts of one number are put together by their lines' numbers."""
    from basepack.plans import queries

    rows = [(7, "s", "ab\nc"), (-3, "s", "é\n"), (9000, "s", "xy"), (7, "s", "d"), (1, "t", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    known, lines = queries._sources(spark, str(tmp_path))
    assert {(r.name, r.logical_length) for r in known.collect()} == {("s", 7), ("t", 0)}
    assert sorted(map(tuple, lines.collect())) == [("s", 0, "N"), ("s", 1, "abdc"), ("s", 5, "xy")]


def test_groups_are_written_and_read_without_joins(spark, tmp_path, monkeypatch):
    """Chunks that compress well were the side that a join broadcast; folders of chunks were listed on the driver."""
    from basepack.sources import files

    def refused(*_, **__):
        raise AssertionError("not for chunks")

    monkeypatch.setattr(files, "listing", refused)
    monkeypatch.setattr(type(spark.range(1)), "join", refused)
    chunks = spark.createDataFrame([("a", 0, b"12"), ("a", 2, b"5"), ("other", 0, b"1")], "array string, chunk_idx long, payload binary")
    arrays = [{"array": "a", "shape": 3, "chunk_bytes": 2, "attributes": {}}]
    root = zarr3.write_group(str(tmp_path / "x"), {"k": 1}, arrays, chunks, "zstd")
    attributes, found = zarr3.read_group(spark, root)
    assert attributes == {"k": 1} and [r.array for r in found.collect()] == ["a"]
    got = zarr3.read_chunks(spark, root, found).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, bytes(r.payload)) for r in got] == [(0, b"12"), (1, b"\0")]
