from basepack.llm import langid


def learned(df):
    return langid.profiles(df, "text", "lang")


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = langid.op10_rank_order_language_id(spark, sf).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got if r.held_out) >= 0.98 * sum(r.held_out for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def brute(text, profiles, top):
    """Out-of-place distances, one n-gram after another."""
    from collections import Counter

    def ranked(counts):
        return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}

    own = ranked(Counter(langid.grams(langid.letters(text)).tolist()))
    far = {lang: sum(abs(k - r[g]) if g in r else top for g, k in own.items()) for lang, r in ((lang, ranked(c)) for lang, c in profiles.items())}
    best = min(far, key=lambda x: (far[x], x))
    return best, 1 - far[best] / (top * len(own))


def test_distances(spark, frame):
    from collections import Counter

    rows = [(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, "the end", "en"), (4, None, "de"), (5, "123 !", "en"), (6, "le chat", None), (7, "ÉTÉ", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = {}
    for _, t, lang in rows:
        if lang and langid.has_letter(t):
            profiles.setdefault(lang, Counter()).update(langid.grams(langid.letters(t)).tolist())
    for most in (10, langid.MOST_SENT):
        got = {r.doc_id: r for r in langid.predict(df, langid.profiles(df, "text", "lang", 30), top=30, most_sent=most).collect()}
        assert (got[4].lang_pred, got[4].score, got[5].lang_pred) == ("und", 0.0, "und")
        for i, t, _ in rows:
            if langid.has_letter(t):
                best, score = brute(t, profiles, 30)
                assert got[i].lang_pred == best and abs(got[i].score - score) < 1e-9


def test_awkward(spark, frame, docs):
    df = frame(docs + [(None, "x"), (0, "again")])
    got = langid.predict(df, learned(df)).collect()
    assert len(got) == len(docs) + 2
    assert {r.lang_pred for r in got if r.doc_id in (30, 31, 32)} == {"und"}
    nothing = langid.predict(df, learned(df.where("false"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.predict(frame([]), learned(df)).collect() == []


def test_pieces_give_the_counts_of_whole_texts(monkeypatch):
    import numpy as np

    texts = [langid.letters(t) for t in ("", "a", "Ab  c", "the end, thé énd 12 " * 40, "x" * 17, "1")]
    whole = [langid.counted([c]) for c in texts], langid.counted(texts)
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for (codes, n), c in zip(whole[0], texts):
            assert all(np.array_equal(x, y) for x, y in zip((codes, n), langid.counted([c])))
            assert np.array_equal(np.sort(langid.grams(c)), np.repeat(codes, n))
        assert all(np.array_equal(x, y) for x, y in zip(whole[1], langid.counted(texts)))


def test_clashing_names(spark):
    rows = [(1, "the end", "en", "r", [5], "x"), (2, None, "de", "r", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, own array<int>, best string")
    for most in (0, langid.MOST_SENT):
        got = langid.predict(df, learned(df), most_sent=most)
        assert got.columns == [*df.columns, "lang_pred", "score"]
        assert sorted((r.doc_id, r.row, r.own, r.best, r.lang_pred) for r in got.collect()) == [(1, "r", [5], "x", "en"), (2, "r", None, "x", "und")]


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "the end " * 300_000, "en"), (2, "das ende " * 10, "de")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang_pred) for r in langid.predict(df, learned(df)).collect()) == [(1, "en"), (2, "de")]
