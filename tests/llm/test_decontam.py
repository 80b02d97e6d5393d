import random

import numpy as np

from basepack.llm import decontam


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(30):
        item, rows = rng.integers(1, 6, rng.integers(1, 12)), rng.integers(0, 6, (4, rng.integers(1, 20)))
        best, _ = decontam.smith_waterman(item, rows)
        assert list(best) == [smith_waterman(item, r) for r in rows]


def brute(rows, items):
    out = set()
    for i, t in rows:
        w = decontam.tokens(t)
        for k, x in items:
            m = decontam.tokens(x)
            if len(m) >= decontam.LEAST_WORDS and smith_waterman(m, w) >= decontam.THRESHOLD * len(m):
                out.add((i, k))
    return out


def test_leaks(spark, frame):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(12, 40)))) for k in range(8)] + [(8, None), (9, ""), (10, "Tiny"), (11, items_text := "rare pair")]
    rows = []
    for i in range(60):
        before, after = text(rng.randint(0, 60)), text(rng.randint(0, 60))
        middle = []
        if i % 2:
            middle = items[i % 8][1].split()
            for _ in range(i % 5):
                at = rng.randrange(len(middle))
                middle[at : at + 1] = rng.choice([[], [word()], [word(), middle[at]], [middle[at].upper() + ","]])
        rows.append((i, " ".join(before + middle + after)))
    rows += [(60, None), (61, ""), (62, "the tiny one"), (63, f"a {items_text} b"), (64, " ".join(text(20_000))), (1, rows[1][1])]
    df, bench = frame(rows), spark.createDataFrame(items, "item_id long, text string")
    expected = brute([r for r in rows if r[0] != 64], items)
    for options in ({}, {"block_bytes": 200}):
        got = decontam.leaks(df, bench, **options).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.doc_id != 64} == expected
        assert len(got) == len({(r.doc_id, r.item_id) for r in got}) + sum(i == 1 for i, _ in expected)  # two equal rows
    clean = decontam.decontaminated(df, bench)
    assert clean.columns == df.columns
    bad = {i for i, _ in expected}
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id != 64) == sorted(i for i, _ in rows if i not in bad and i != 64)


def test_seeds_survive_a_common_passage(spark, frame):
    """An item in most documents is found in all of them."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, f"w{i} {item} v{i}" if i % 4 else f"clean {i}") for i in range(400)]
    got = decontam.leaks(frame(rows), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i in range(400) if i % 4}


def test_empty(spark, frame, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(frame(docs), bench).collect() == []
    assert decontam.leaks(frame([]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert decontam.decontaminated(frame([(None, "x")]), bench).count() == 1


def test_only_edited_copies(spark, frame):
    """Items that leaked as edited copies only, one of them as an exact copy also; against brute force."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 6)))
    items = [(k, [word() for _ in range(m)]) for k, m in enumerate([24, 24, 24, 8, 5, 2, 33, 40])]
    every = lambda ws, n, at, to: [y for i, w in enumerate(ws) for y in (to(w) if i % n == at else [w])]
    replaced, doubled, dropped = lambda w: [word()], lambda w: [w, word()], lambda w: []
    rows = []
    for k, ws in items:
        edits = [every(ws, 6, 3, replaced), every(ws, 4, 2, replaced), every(ws, 3, 2, replaced), every(ws, 2, 1, doubled), every(ws, 5, 2, dropped)]
        rows += [(10 * k + n, " ".join([word() for _ in range(30)] + e + [word() for _ in range(30)])) for n, e in enumerate(edits)]
    rows.append((7, " ".join(items[0][1])))
    items = [(k, " ".join(ws)) for k, ws in items]
    expected = brute(rows, items)
    assert {(0, 0), (10, 1), (20, 2), (23, 2), (32, 3)} <= expected and not {i for _, i in expected} & {5}  # replaced words, words put in between, two of three left
    got = decontam.leaks(frame(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected


def test_seeds_lose_no_leak():
    """Small alphabets, all thresholds: where the score is reached, a seed and the n-grams needed are in the text."""
    rng = random.Random(2)
    for n in range(600):
        a = [b"%d" % rng.randrange(9) for _ in range(rng.randint(1, 14))]
        b = [x for w in a for x in rng.choice([[w], [w], [w], [b"x"], [], [w, b"y"]])]
        items = decontam.Items([(0, a)], 3, threshold := rng.choice([0.3, 0.5, 0.7, 1.0]))
        if smith_waterman(a, b) >= threshold * len(a):
            _, index = items.hits(items.number_of(b), items.distinct)
            held = set(index.tolist())
            seeds = items.seeds(np.array([rng.randrange(3) for _ in items.distinct]))
            assert sum(g in held for g in items.grams[0]) >= items.need[0] > 0
            assert held & {items.grams[0][s] for s in seeds.tolist()}


def test_each_row_for_itself(spark, frame):
    """Rows that repeat a doc_id, items that repeat an item_id, null ids, items too short to look for."""
    first, second = "alpha beta gamma delta epsilon", "one two three four five six"
    rows = [(1, f"x {first} y"), (1, "clean"), (None, first), (None, "clean too"), (2, f"{second} now {first}"), (2, f"{second} now {first}"), (3, "now"), (4, None)]
    items = [(7, first), (7, second), (None, second), (8, "now"), (9, "so it is"), (10, ""), (11, None)]
    df, bench = frame(rows), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_bytes": 100}):
        got = decontam.leaks(df, bench, **options)
        best = got.groupBy("doc_id", "item_id").count().collect()
        assert {(r.doc_id, r.item_id) for r in best} == {(1, 7), (None, 7), (2, 7), (2, None)}
        assert {r.score for r in got.collect()} == {1.0}
        kept = decontam.decontaminated(df, bench, **options)
        assert kept.columns == df.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean too"), (1, "clean"), (3, "now"), (4, "")]
    assert sorted((r.item_id, r.text) for r in decontam.short_items(bench).collect()) == [(8, "now"), (9, "so it is"), (10, ""), (11, None)]


def test_best_alignment_has_its_end(spark, frame):
    item = "alpha beta gamma delta epsilon zeta"
    got = decontam.leaks(frame([(1, "alpha beta gamma delta x y z a b c d e f g " * 3 + item + " " + item)]), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [(r.score, r.end_word) for r in got] == [(1.0, 47)]
