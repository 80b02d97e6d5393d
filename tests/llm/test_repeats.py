import hashlib
import sys

import numpy as np
import pyarrow as pa
import pytest

from basepack.llm import kernels as K
from basepack.llm import segments, substring_dedup, suffix_dedup

SIZES = [{}, {"hot": 0}, {"hot": 0, "batch_bytes": 2000, "bucket_bytes": 3000, "shard_bytes": 1000}, {"batch_bytes": 500, "bucket_bytes": 3000, "shard_bytes": 500}]


def brute_words(rows):
    seen = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            seen[k] = min(seen.get(k, (i, s)), (i, s))
    for i, t in rows:
        w = (t or "").encode().split()
        m = [False] * len(w)
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] < (i, s):
                m[s : s + 20] = [True] * 20
        yield i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, r in zip(w, m) if not r)).hexdigest()


def brute_bytes(rows):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            seen[b[s : s + 50]] = min(seen.get(b[s : s + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < i:
                m[s : s + 50] = True
        yield i, len(b), int(m.sum()), len(K.runs_of(m)[0]), hashlib.sha256(bytes(x for x, r in zip(b, m) if not r)).hexdigest()


@pytest.mark.parametrize("sizes", SIZES)
def test_words(frame, docs, sizes):
    got = substring_dedup.digests(substring_dedup.repeats(frame(docs), **sizes))
    assert sorted(map(tuple, got.collect())) == sorted(brute_words(docs))


@pytest.mark.parametrize("sizes", SIZES)
def test_bytes(frame, docs, sizes):
    got = suffix_dedup.digests(suffix_dedup.repeats(frame(docs), **sizes))
    assert sorted(map(tuple, got.collect())) == sorted(brute_bytes(docs))


def test_repeated_rows_and_null_ids(frame):
    text = " ".join(f"w{i}" for i in range(60))
    got = suffix_dedup.digests(suffix_dedup.repeats(frame([(5, text), (5, text), (None, text)]))).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in got) == [(5, 0), (5, 0), (99, len(text))]
    got = substring_dedup.digests(substring_dedup.repeats(frame([(5, text), (5, text), (None, text)]))).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in got) == [(5, 0), (5, 0), (99, 60)]


def test_texts(frame):
    text = " ".join(f"w{i}" for i in range(40))
    df = frame([(1, text), (2, f"before {text} after"), (3, None)])
    for module in (suffix_dedup, substring_dedup):
        out = module.dedup(module.repeats(df))
        assert out.columns == df.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        assert kept[1] == text and kept[3] is None and kept[2].split() == ["before", "after"]


def test_empty_table(frame):
    for module in (suffix_dedup, substring_dedup):
        assert module.digests(module.repeats(frame([]))).collect() == []
        assert module.dedup(module.repeats(frame([]))).collect() == []


def test_words_are_read_without_an_object_for_each(docs):
    rng = np.random.default_rng(6)
    texts = [(t or "").encode() for _, t in docs] + [b"  a\x00b \t\x0b\x0c\r\n c\x1f d ", b"x" * 8 + b" " + b"x" * 9 + b" " + b"x" * 64 + b" " + b"x" * 65 + b" " + b"x" * 300, b" "]
    texts += [bytes(rng.choice(np.frombuffer(b"ab \n\xc3", np.uint8), 400)) for _ in range(20)]
    for some in (texts, texts[:1], [], [b""], [b"", b" ", b""], [b"a"], [b"", b"a b"]):
        block = substring_dedup.read_words("text")(pa.table({"text": pa.array(some, pa.binary())}))
        words = [t.split() for t in some]
        every = [w for ws in words for w in ws]
        assert block.bounds.tolist() == np.cumsum([0, *map(len, words)]).tolist()
        assert [block.piece(i, i) for i in range(len(every))] == every
        assert not every or block.piece(0, len(every) - 1) == b" ".join(every)
        got = block.symbols(0, len(every)).tolist()
        assert len(set(got)) == len(set(every)) == len(set(zip(got, every)))
        for i, j in ((3, 40), (len(every) - 1, len(every)), (7, 7)):
            assert block.symbols(i, j).tolist() == got[i:j]
    table = pa.table({"text": pa.array([b" ".join(b"w%d" % i for i in range(50_000))])})
    before = sys.getallocatedblocks()
    block = substring_dedup.read_words("text")(table)
    symbols = block.symbols(0, 50_000)
    assert len(np.unique(symbols)) == 50_000
    assert sys.getallocatedblocks() - before < 5_000


def test_previous_factors():
    value, lcp = np.array([3, 1, 2, 0, 5]), np.array([0, 60, 70, 55, 51])
    assert list(suffix_dedup.previous_factors(value, lcp, 50)) == [0, 0, 70, 0, 51]


@pytest.mark.parametrize("n, symbols", [(0, 3), (1, 1), (500, 11), (3000, 400), (64, 1)])
def test_wavelet_ranks(n, symbols):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.geometric(0.05 if symbols > 20 else 0.3, n) - 1, symbols - 1)
    tree = substring_dedup.WaveletTree(x, symbols + 1)
    at = np.arange(n + 1)
    for c in range(symbols + 1):
        assert np.array_equal(tree.rank(np.full(n + 1, c), at), np.concatenate([[0], np.cumsum(x == c)]))
    if symbols > 20:  # short codes for frequent symbols: fewer bits than plain planes have
        assert tree.length[x].sum() < n * int(symbols).bit_length()


@pytest.mark.parametrize("window", [1, 3, 6])
@pytest.mark.parametrize("symbols", [2, 4, 30])
def test_matching_statistics_of_other_documents(window, symbols):
    """Patterns that the index does not hold: longest matches and where they stand, against a scan."""
    rng = np.random.default_rng(symbols * 10 + window)
    pieces = [rng.integers(1, symbols, rng.integers(0, 40)).tolist() for _ in range(12)]
    text = np.array([c for p in pieces for c in [*p, 0]])
    index = substring_dedup.FMIndex(text, window, age := rng.permutation(len(text)))
    patterns = rng.integers(1, symbols + 2, 200)
    patterns[patterns > symbols] = -1
    ends = np.array([0, 30, 31, 90, 200])
    length, lo, hi = index.statistics(patterns, ends[:-1], ends[1:])
    least = index.least_age(lo, hi)
    for a, z in zip(ends, ends[1:]):
        for i in range(a, z):
            best = 0
            while best < min(window, z - i) and any(text[s : s + best + 1].tolist() == patterns[i : i + best + 1].tolist() for s in range(len(text) - best)):
                best += 1
            at = [s for s in range(len(text)) if text[s : s + best].tolist() == patterns[i : i + best].tolist() and s + best <= len(text)]
            assert length[i] == best
            if best:
                assert hi[i] - lo[i] == len(at) and least[i] == min(age[s] for s in at)


@pytest.mark.parametrize("window, k", [(50, 20), (20, 6)])
def test_anchors_of_texts_longer_than_positions_reach(monkeypatch, window, k):
    """With 12 bits for positions instead of 26: long texts have the anchors that they have with 26."""
    rng = np.random.default_rng(4)
    sizes = [300, 30_000, 10, 900, 5_000, 0, 1_000, 1_049, 12_000]
    x = rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    x[20_000:20_600], x[9_000:11_000] = x[:600], x[8_000]
    block = segments.Block(lambda i, j: x[i:j], np.concatenate([[0], np.cumsum(sizes)]), b"", None, None)
    expected = segments._anchors(block, window, k)
    monkeypatch.setattr(K, "_POS_MASK", np.uint64((1 << 12) - 1))
    monkeypatch.setattr(K, "MAX_BLOCK", 1 << 12)
    monkeypatch.setattr(segments, "PART_SYMBOLS", 1000)
    assert all(np.array_equal(a, b) for a, b in zip(segments._anchors(block, window, k), expected))
    with pytest.raises(ValueError):
        K.anchored_runs(x[: (1 << 12) + 1], np.array([0, 1 << 12]), window, k)


@pytest.mark.parametrize("window", [63, 64, 130])
def test_bytes_of_wider_windows(frame, window):
    rng = np.random.default_rng(window)
    text = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = [text(n) for n in (window - 1, window, window + 1, 3 * window)]
    rows = [(4 * i + k, text(int(rng.integers(0, 90))) + s + text(int(rng.integers(0, 90)))) for i in range(4) for k, s in enumerate(shared)]
    seen = {}
    for i, t in rows:
        for s in range(len(t) - window + 1):
            seen.setdefault(t[s : s + window], i)
    expected = []
    for i, t in rows:
        m = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] < i:
                m[s : s + window] = True
        expected.append((i, len(t), int(m.sum()), len(K.runs_of(m)[0]), hashlib.sha256("".join(c for c, r in zip(t, m) if not r).encode()).hexdigest()))
    got = suffix_dedup.digests(suffix_dedup.repeats(frame(rows), window=window))
    assert sorted(map(tuple, got.collect())) == expected


def test_anchors_deal_evenly():
    from basepack.llm import batches as B

    data = np.random.default_rng(8).integers(0, 1 << 63, 200_000).astype(np.uint64)
    block = segments.Block(lambda i, j: data[i:j], np.array([0, len(data)]), b"", None, None)
    dealt = np.bincount(B.bucket_of(segments._anchors(block, 50, 20)[2], 50), minlength=50)
    assert dealt.max() < 1.5 * dealt.mean()
