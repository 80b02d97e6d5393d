import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basepack.llm import hmm

def model(df, **options):
    return hmm.Model(df, F.col("doc_id") % 3 == 0, **options)


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def test_base_and_counts(frame, docs):
    rows = docs + [(None, "one two")]
    got = model(frame(rows), rounds=1, batch_bytes=3000, bucket_bytes=4000).scores().collect()
    count = Counter(w for i, t in rows if i is None or i % 3 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    texts = dict(rows)
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r.held_out == (r.doc_id is not None and r.doc_id % 3 == 0)
        assert r.score < 0


def test_exact_likelihood():
    """Forward recursion against the sum over all paths."""
    rng = np.random.default_rng(1)
    emit = rng.random((6, 3))
    p = hmm.Parameters(np.array([0.5, 0.3, 0.2]), (s := rng.random((3, 3))) / s.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    classes, bounds = rng.integers(0, 6, 12), np.array([0, 5, 6, 6, 12])
    got = hmm.log_likelihoods(classes, bounds, p)
    for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
        total = 0.0 if j > i else 1.0
        for path in itertools.product(range(3), repeat=int(j - i)) if j > i else ():
            x = p.first[path[0]] * p.emit[classes[i], path[0]]
            for t in range(1, j - i):
                x *= p.step[path[t - 1], path[t]] * p.emit[classes[i + t], path[t]]
            total += x
        assert got[k] == pytest.approx(math.log10(total))


def test_expected_counts():
    """Baum-Welch counts against the sum over all paths."""
    rng = np.random.default_rng(2)
    emit = rng.random((4, 2))
    p = hmm.Parameters(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit / emit.sum(axis=0))
    classes, n = rng.integers(0, 4, 9), np.array([4, 5])
    first, step, out = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for a, m in zip((0, 4), n):
        paths = {}
        for path in itertools.product(range(2), repeat=int(m)):
            x = p.first[path[0]] * p.emit[classes[a], path[0]]
            for t in range(1, m):
                x *= p.step[path[t - 1], path[t]] * p.emit[classes[a + t], path[t]]
            paths[path] = x
        total = sum(paths.values())
        for path, x in paths.items():
            first[path[0]] += x / total
            for t in range(m):
                out[classes[a + t], path[t]] += x / total
                if t:
                    step[path[t - 1], path[t]] += x / total
    for chunk in (1, 2, 3, 4, 100):
        for got, expected in zip(hmm.expected(classes, np.array([0, 4]), n, p, chunk), (first, step, out)):
            assert np.allclose(got, expected, atol=1e-5)


def test_borders_of_lanes_leave_no_trace():
    """Long texts in lanes of any length give the counts that they give in one."""
    rng = np.random.default_rng(5)
    emit = rng.random((30, 5)) ** 4
    p = hmm.Parameters((f := rng.random(5)) / f.sum(), (s := rng.random((5, 5)) ** 3) / s.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    lengths = np.array([1, 700, 2, 33, 1500, 64, 65, 66, 1, 128])
    classes, starts = rng.integers(0, 30, lengths.sum()), np.cumsum(lengths) - lengths
    whole = hmm.expected(classes, starts, lengths, p, 1 << 20)
    assert whole[0].sum() == pytest.approx(len(lengths), rel=1e-4)
    assert whole[1].sum() == pytest.approx((lengths - 1).sum(), rel=1e-4) and whole[2].sum() == pytest.approx(lengths.sum(), rel=1e-4)
    for chunk in (1, 7, 64, 500):
        for got, expected in zip(hmm.expected(classes, starts, lengths, p, chunk), whole):
            assert np.allclose(got, expected, rtol=2e-3, atol=2e-3)


def test_scores_end_to_end(frame):
    """A score is the words' probabilities in their classes times the sum over all paths, with the learned parameters."""
    rows = [(1, "the cat sat"), (2, "the dog sat on the cat"), (4, "a dog"), (5, None), (5, "the end"), (3, "the cow sat"), (6, "THE dog"), (6, "")]
    m = model(frame(rows), states=2, rounds=2)
    p, learning = m.parameters, [t for i, t in rows if i % 3]
    count = Counter(w for t in learning for w in tokens(t))
    of = lambda w: 0 if w is None else hmm.word_class(w)
    total, kinds = Counter(), Counter()
    for w, n in count.items():
        total[of(w)] += n
        kinds[of(w)] += 1
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in m.scores().collect())
    expected = []
    for i, t in rows:
        x, words = 0.0, tokens(t)
        for path in itertools.product(range(2), repeat=len(words)):
            y = p.first[path[0]]
            for k, w in enumerate(words):
                y *= (p.step[path[k - 1], path[k]] if k else 1) * p.emit[of(w), path[k]]
            x += y
        expected.append((i, len(words), math.log10(x) + sum(math.log10((count[w] + 1) / (total[of(w)] + kinds[of(w)] + 1)) for w in words)))
    assert len(got) == len(rows)
    for g, e in zip(got, sorted(expected)):
        assert g == pytest.approx(e)


def test_better_than_base_on_held_out(spark, sf):
    got = [r for r in hmm.op9_hmm_language_model(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_nothing_to_learn(frame):
    assert model(frame([]), rounds=1).scores().collect() == []
    got = model(frame([(3, "a b"), (6, None)]), rounds=1).scores().collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
