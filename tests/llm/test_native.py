"""URL filter and quality ledger: rules against plain Python, the model against its own definition."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from basepack.llm import quality, url_filter

URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.NET/en/x?y#z",
    "http://example.net",
    "http://notexample.net/en/",
    "https://x.example.com/de/1",
    "https://x.example.com?u=/de/",
    "ftp://x.org/fr/#a?b",
    "http://org/fr/",
    "a://b://c/d",
    "http://ÜBER.com/ä?ö",
    "https://spam-farm.example.com/en/1",
    "https://river.example.com/en/1",
    "http://h.com/" + "p" * 20_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string, host string")
    return url_filter.judge(df, url_filter.labelled(spark)).collect()


def test_rules(judged):
    assert len(judged) == 2 * len(URLS)
    for r in judged:
        host, path = parts(r.url)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_score_is_the_models(spark, judged):
    """The weights and bins that Spark gives, put together in plain Python."""
    *weights, bias = url_filter.train(url_filter.labelled(spark)).first().weights
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    bins = {r.url: r.b for r in df.select("url", url_filter.bins(*url_filter.parts(F.col("url")), url_filter.BINS).alias("b")).collect()}
    for r in judged:
        b = bins[r.url]
        assert len(b) == sum(max(0, len(t) + 2 - n + 1) for t in parts(r.url) for n in url_filter.ORDERS)
        margin = bias + sum(weights[k] for k in b) / math.sqrt(max(1, len(b)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)))


def test_sites_never_seen(spark, sf):
    """Folds by site: most unwanted sites are blocked and most wanted ones are not; no site is a host of the judged tables."""
    right = {0: 0, 1: 0}
    for fold in range(2):
        table = url_filter.labelled(spark, (fold, 2)).cache()
        learn, rest = table.where("not held_out"), table.where("held_out").withColumnRenamed("label", "is")
        for r in url_filter.judge(rest, learn, rules=()).collect():
            right[r["is"]] += (r.verdict == "block") == bool(r["is"])
    assert right[1] > 0.55 * 2 * len(url_filter._UNWANTED) and right[0] > 0.9 * 2 * len(url_filter._WANTED)
    hosts = spark.read.parquet(f"{sf}/pages.parquet").select(url_filter.parts(F.col("url"))[0].alias("h")).distinct().collect()
    names = {part for r in hosts for part in r.h.split(".")}
    assert not names & {*url_filter._UNWANTED, *url_filter._WANTED}


def test_labelled_tables(spark):
    """A larger one is cut in order; an empty one gives 0.5; clashing columns of the judged table stay."""
    df = spark.createDataFrame([(1, "http://a.com/x", "w", "l"), (1, "http://a.com/x", "w", "l"), (None, None, None, None)], "page_id long, url string, weights string, label string")
    none = spark.createDataFrame([], "url string, label int")
    got = url_filter.judge(df, none).collect()
    assert len(got) == 3 and {(r.score, r.verdict) for r in got} == {(0.5, "block")} and [r.weights for r in got].count("w") == 2
    rows = [(f"http://{i:05}.com/", i % 2) for i in range(url_filter.MOST_LABELLED + 50)]
    table = lambda x: spark.createDataFrame(x, "url string, label int").repartition(3)
    assert url_filter.train(table(rows), 16, 1).first() == url_filter.train(table(rows[: url_filter.MOST_LABELLED]), 16, 1).first()


def test_training_is_gradient_descent(spark):
    """The same descent in plain Python, on the bins that Spark gives."""
    rows = [("http://good.com/a", 0), ("http://bad.com/b", 1), ("http://bad.org", 1)]
    df = spark.createDataFrame(rows, "url string, label int")
    n = 64
    bins = [r.b for r in df.select(url_filter.bins(*url_filter.parts(F.col("url")), n).alias("b"), "label").collect()]
    w, bias, rate, decay = [0.0] * n, 0.0, url_filter.RATE, url_filter.DECAY
    for _ in range(5):
        miss = []
        for b, (_, y) in zip(bins, rows):
            share = 3 / 2 / (2 if y else 1)
            miss.append(share * (y - 1 / (1 + math.exp(-(bias + sum(w[k] for k in b) / math.sqrt(len(b)))))))
        grad = [0.0] * n
        for b, m in zip(bins, miss):
            for k in b:
                grad[k] += m / math.sqrt(len(b))
        w = [x * (1 - decay * rate) + rate / 3 * g for x, g in zip(w, grad)]
        bias += rate / 3 * sum(miss)
    got = url_filter.train(df, n, 5).first().weights
    assert got == pytest.approx([*w, bias])


def test_no_urls(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.labelled(spark)).collect() == []


def test_no_python(spark, sf):
    for query in (url_filter.op4_url_logistic_filter, quality.op6_quality_rule_ledger):
        assert not re.search("Python|Pandas|Arrow", query(spark, sf)._jdf.queryExecution().toString())


EXTRA = [(50, "a a a a"), (51, "a b c a b c"), (52, "x\ny\nx\n \n \n\nx"), (53, "A" * 50), (54, "# $ %" * 30), (55, "a b c " * 40), (56, "w! " * 60)]


def test_ledger(frame, docs):
    rows = docs + EXTRA
    got = {r.doc_id: r for r in quality.ledger(frame(rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + d for k, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)} if len(w) < 3000 else None
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        if again is not None:
            assert r.n_repeat_words == len(again)


def test_ledger_sql(spark, sf):
    got = quality.op6_quality_rule_ledger(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = con.sql(quality.SQL)
    names = sorted(got.columns)
    assert sorted(expected.columns) == names
    assert sorted(map(tuple, got.select(names).collect())) == sorted(expected.select(*names).fetchall())


def test_ablations(frame, docs):
    rows = quality.ledger(frame(docs + EXTRA)).cache()
    bits = [r.fail_bits for r in rows.collect()]
    mask = quality.mask("v1")
    for r in quality.ablations(rows, "v1").collect():
        bit = 1 << [n for n, _ in quality.RULES].index(r.rule)
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))
    assert quality.ledger(frame([])).collect() == []
