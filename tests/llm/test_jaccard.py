import random

import pytest

from basepack.llm import partitions
from basepack.llm.jaccard import JaccardJoin


def sets(rows, n):
    for i, t in rows:
        w = (t or "").encode().lower().split()
        yield i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    found = list(sets(rows, n))
    root = {i: i for i, _ in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(found):
        for j, b in found[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i)) for i, a in found)


def families(seed):
    """Chains of edits around the threshold, small and large sets."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    rows, i = [], 0
    for _ in range(14):
        w = [word() for _ in range(rng.choice([2, 4, 8, 15, 30, 80, 200]))]
        for _ in range(rng.randint(1, 12)):
            rows.append((i, " ".join(w)))
            i += 1
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [64, 1])
def test_components(frame, n, num, seed, hot):
    rows = families(seed)
    got = JaccardJoin(frame(rows), n=n, num=num, den=100, hot=hot, batch_bytes=3000, bucket_bytes=4000).rows()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, n, num, 100)


def test_awkward(frame, docs):
    got = JaccardJoin(frame(docs), n=3, num=90, den=100).rows().collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs, 3, 90, 100)
    assert JaccardJoin(frame([])).rows().collect() == []


def test_kept(frame, docs):
    df = frame(docs + [(0, docs[0][1]), (None, "one")])
    join = JaccardJoin(df, n=5, num=80, den=100)
    kept = join.kept()
    assert kept.columns == df.columns
    expected = sorted({c for _, _, c in brute(docs, 5, 80, 100)})
    assert sorted(r.doc_id for r in kept.collect()) == expected


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_pigeonhole(num, den):
    """Segments and allowances always leave more meetings than may be left out."""
    edges = partitions.bands(num, den)
    for band in range(30):
        m, v, skips = partitions.plan(band, num, den)
        top = int(edges[band + 1]) - 1
        h = (den - num) * (top + top * den // num) // (den + num)
        assert m * (v + 1) >= h + 1 + skips * (v + 1)
        assert all(t in range(int(edges[band]), int(edges[band + 2])) for t in (s * den // num for s in range(int(edges[band]), min(top, int(edges[band]) + 50) + 1)))


@pytest.mark.parametrize("block", [1024, 7])
def test_a_large_family_around_the_threshold(frame, monkeypatch, block):
    """Copies with random edits, of which some pairs link and many just do not: all turns together lose no link."""
    from basepack.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    join = JaccardJoin(frame(rows), n=5, num=80, den=100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.rows().collect()) == brute(rows, 5, 80, 100)


def test_turns_take_every_pair_once():
    """All turns of a group give, together, the pairs of one turn without end, each once, and say when some are left."""
    import numpy as np
    import pyarrow as pa

    from basepack.llm.jaccard import _could_link

    rng = np.random.default_rng(3)
    n = 40
    sketches = [bytes(rng.integers(0, 256, 32, dtype=np.uint8)) for _ in range(3)]
    comp = rng.integers(0, 30, n)
    table = pa.table({"row": np.arange(n), "comp": comp, "now": comp, "n": np.full(n, 80), "block": np.zeros(n, np.int64), "sig": np.full(n, 5), "bi": np.zeros(n, np.int64), "bj": np.zeros(n, np.int64), "sketch": [sketches[i % 3] for i in range(n)], "low": [[2, 5] if i in (0, 3, 4) else [3, 5, 6] if i == 6 else [5, 6] for i in range(n)]})
    got, turn = [], 0
    while True:
        out = _could_link(80, 100, turn)(table).to_pylist()
        got += [(r["a"], r["b"]) for r in out if r["a"] is not None]
        assert len(out) <= n * 8**turn + 1
        if all(r["a"] is not None for r in out):
            break
        turn += 1
    assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if comp[i] != comp[j] and i % 3 == j % 3 and (i, j) != (0, 3)] and turn


def test_signatures_of_one_node_go_and_turns_read_mixed_groups_only(frame, docs):
    """No kept signature is one node's alone, and no turn but the first reads all signatures again."""
    rows = families(1) + [(1000 + i, t) for i, t in docs]
    rows += [(2000 + i, t) for i, t in rows]  # copies, in other batches
    join = JaccardJoin(frame(rows), n=5, num=80, den=100, batch_bytes=3000, bucket_bytes=4000)
    assert join.sigs.groupBy("sig").count().where("count < 2").isEmpty() and not join.sigs.isEmpty()
    groups = join.mixed.selectExpr("sig", "0L bi", "0L bj").distinct()
    read = join._across(join.labels, join.labels, groups, 1).inputFiles()
    assert any("/mixed/" in f for f in read) and not any("/sigs/" in f for f in read)
