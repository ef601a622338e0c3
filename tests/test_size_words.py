from collections import Counter

from pyspark.sql import functions as F

from lexweave.operators import lexical, models


def test_pairs_of_words_are_counted_once_for_both_ways(spark):
    docs = [["a", "b", "a", "a", "c"], ["b"], [], ["c", "a"]]
    got = lexical.context_pairs(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, ids array<string>"), 2)
    want = Counter((x, d[j]) for d in docs for i, x in enumerate(d) for j in range(len(d)) if 0 < abs(i - j) <= 2)
    assert {(r.wid, r.cid): r.n for r in got.collect()} == want
    assert "least(" in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_shortest_ngrams_decide(spark, monkeypatch):
    asked, real = [], models.subword_counts
    monkeypatch.setattr(models, "subword_counts", lambda v, low, high, least: asked.append((low, high)) or real(v, low, high, least))
    words = [("en", "walking", 1), ("en", "walked", 1), ("en", "walks", 1), ("en", "cat", 30), ("en", "aaaaaa", 1), ("fr", "walker", 2), (None, "walk", 40)]
    got = {(r.lang, r.tok): (r.frequent, r.has_subwords) for r in models.words_with_subwords(spark.createDataFrame(words, "lang string, tok string, n long"), 20).collect()}
    assert got == {("en", "walking"): (False, True), ("en", "walked"): (False, True), ("en", "walks"): (False, True), ("en", "cat"): (True, False), ("en", "aaaaaa"): (False, True), (None, "walk"): (True, False)}
    assert asked == [(4, 4)]


def test_peaks_are_found_where_the_words_are(spark):
    vocab = spark.createDataFrame([("en", w) for w in ("undo", "untie", "unfold", "redo", "retie", "do", "tie", "fold", "a", "")] + [("fr", "undo"), (None, "undone")], "lang string, tok string")
    got = lexical.entropy_peaks(vocab)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {(*r, "ahead") for r in _peaks(spark, vocab, False)} | {(*r, "behind") for r in _peaks(spark, vocab, True)}


def _peaks(spark, vocab, backwards):
    h = {(r["lang"], r["prefix"]): round(abs(r["entropy"]), 9) for r in lexical.branching_entropy(vocab, backwards).collect()}
    for lang, tok in vocab.filter("lang is not null and length(tok) >= 4").collect():
        w = f"<{tok}>"[:: -1 if backwards else 1]
        for k in range(2, len(w) - 1):
            if h[lang, w[:k]] > max(h[lang, w[: k - 1]], h[lang, w[: k + 1]] if k + 1 < len(w) else 0):
                yield lang, tok, len(w) - k if backwards else k


def test_texts_are_encoded_where_they_are(spark, monkeypatch):
    from lexweave.sources.files import store

    texts = spark.createDataFrame([(1, "en", ["a", "x", "b", "a"]), (2, "fr", ["b"]), (3, "en", ["x"]), (4, None, ["a"]), (5, "en", None)], "doc_id long, lang string, toks array<string>")
    vocab = store(spark.createDataFrame([("en", "a", 0), ("en", "b", 1), ("fr", "b", 0), ("fr", "c", 1)], "lang string, tok string, wid long"), "vocab")
    encoded = lexical.encode_texts(texts, vocab)
    decoded = models.decode(encoded, vocab)
    for made in (encoded, decoded):
        assert "Exchange" not in made._jdf.queryExecution().toString()
    want = {1: [0, 1, 0], 2: [0]}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.toks for r in decoded.collect()} == {1: ["a", "b", "a"], 2: ["b"]}
    monkeypatch.setattr(lexical, "HELD_WORDS", 1)
    assert {r.doc_id: r.ids for r in lexical.encode_texts(texts, vocab).collect()} == want
