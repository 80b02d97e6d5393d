"""Each stage against brute force on what its predecessor kept."""

import corpus_pipeline
from basepack.llm import decontam, langid

from .test_decontam import smith_waterman
from .test_jaccard import brute as brute_components
from .test_packing import verify
from .test_repeats import K, np  # noqa: F401


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        held[name] = before.collect(), docs.collect()
        if name != "packed":
            assert docs.columns == before.columns
    was, now = held["language"]
    assert {r.doc_id for r in now} == {r.doc_id for r in was if langid.has_letter(r.text)}
    was, now = held["near_duplicates"]
    found = brute_components([(r.doc_id, r.text) for r in was], 5, 80, 100)
    assert sorted(r.doc_id for r in now) == sorted({c for _, _, c in found})
    assert {r.doc_id: r.text for r in was}.items() >= {r.doc_id: r.text for r in now}.items()
    was, now = held["repeated_passages"]
    first = {}
    for r in was:
        b = (r.text or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], r.doc_id), r.doc_id)
    left = {r.doc_id: r for r in now}
    assert len(left) == len(was)
    for r in was:
        b = (r.text or "").encode()
        m = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < r.doc_id:
                m[s : s + 50] = True
        assert left[r.doc_id].text == bytes(x for x, y in zip(b, m) if not y).decode("utf-8", "ignore")
        assert left[r.doc_id].n_chars == len(left[r.doc_id].text)
    was, now = held["benchmark_leaks"]
    items = [decontam.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in now}
    for r in was:
        words = decontam.tokens(r.text)
        if len(words) < 400:
            assert (r.doc_id in kept) == all(smith_waterman(m, words) < decontam.THRESHOLD * len(m) for m in items)
    was, now = held["packed"]
    assert verify([(r.doc_id, r.text) for r in was], now) < 0.05


def test_awkward_rows_and_an_empty_table(spark, sf, tmp_path):
    """Null columns, repeated rows and doc_ids, empty and long texts; and no rows at all."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " more", None, None, None), (2, None, "de", "s", 0), (3, "", None, "s", 0), (4, "12 !", "en", "s", 4), (5, "the end " * 30_000, None, "s", 1), (6, "the", "en", None, 3)]
    for k, some in enumerate((rows, [])):
        docs = spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in some], schema)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if name == "language":
                assert {r.doc_id for r in docs.collect()} == ({None, 1, 5, 6} if some else set())
                assert all(r.lang == "en" for r in docs.collect())
            if name == "near_duplicates":
                assert sorted(r.doc_id for r in docs.collect()) == ([1, 5, 6] if some else [])
        assert {r.doc_id for r in docs.collect()} == ({1, 5, 6} if some else set())


def test_workers_keep_one_operators_caches():
    from basepack.llm import caches, words

    words.hashes(words.split([b"some words"])[0])
    assert caches._caches["words"][0]
    caches.use("packing")
    assert not any(c for owner, held in caches._caches.items() if owner != "packing" for c in held)
    small = dict.fromkeys(range(9))
    caches.bound(small, 9)
    assert len(small) == 9
    caches.bound(small, 8)
    assert not small
