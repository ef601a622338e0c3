import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.functions import text as T
from lexweave.functions import vectors as V
from lexweave.operators import bitext, corpus, lexical, segmenter
from lexweave.sources import files

OK = settings(max_examples=60, deadline=None)


def test_tokens_are_those_of_a_split(spark):
    texts = ["", "a b", "½ x_1, y--z!", "L'été 12.5", " \n\t"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t"))).collect()]
    assert got == [[x for x in re.split(r"(\W)", t) if x.strip()] for t in texts]


def test_entities_and_tags(spark):
    row = spark.createDataFrame([("<p>a &amp;lt; b</p><br>&#x41;<script>x</script>&copy;<!-- y -->",)], "t string")
    assert row.select(T.replace_entities(T.replace_tags(T.delete_elements(F.col("t"))))).first()[0] == "\na &lt; b\n\nA©"


def test_ngrams_and_insertion(spark):
    row = spark.createDataFrame([("abcd",)], "w string")
    assert row.select(T.ngrams(F.col("w"), 4, 6)).first()[0] == ["<abc", "abcd", "bcd>", "<abcd", "abcd>"]
    assert row.select(T.insert_at(F.col("w"), F.array(F.lit(1), F.lit(3)))).first()[0] == "a#bc#d"


def _cost(l1, l2, path):
    total = i = j = 0
    for a, b in path:
        total += -math.log(bitext.STEPS[a, b])
        if a and b:
            total += bitext.length_cost(sum(l1[i : i + a]), sum(l2[j : j + b]))
        i, j = i + a, j + b
    return total


def _paths(n, m):
    if not n and not m:
        yield []
    for a, b in bitext.STEPS:
        if a <= n and b <= m:
            for rest in _paths(n - a, m - b):
                yield [(a, b), *rest]


@OK
@given(st.lists(st.integers(1, 60), min_size=1, max_size=4), st.lists(st.integers(1, 60), min_size=1, max_size=4))
def test_alignment_is_the_cheapest_and_tiles_both_sides(l1, l2):
    got = bitext.align_gap(l1, l2)
    assert [x for s, n, *_ in got for x in range(s, s + n)] == list(range(len(l1)))
    assert [x for *_, s, n, _ in got for x in range(s, s + n)] == list(range(len(l2)))
    assert got[-1][4] == pytest.approx(min(_cost(l1, l2, p) for p in _paths(len(l1), len(l2))))


def test_gap_without_first_side_keeps_second():
    assert [x[2:4] for x in bitext.align_gap([], [5, 6])] == [(0, 1), (1, 1)]


def test_anchors():
    t1, t2 = ["A.", "long " * 20, "B.", "x"], ["1.", "lang " * 20, "2.", "y"]
    assert bitext.find_anchors(t1, t2, {"a.": ["1."], "b.": ["2."]}, []) == [(0, 0), (1, 1), (2, 2)]
    assert bitext.find_anchors(["(3)"], ["3."], {}, [(1, 9, r"\((\d)\)", "{0}.", (1,))]) == [(0, 0)]


def test_precision_recall_counts_null_sides(spark):
    rows = [(1, 1, 1, 1, None, 0), (1, 2, 2, 1, 1, 2)]
    g = spark.createDataFrame(rows, "pair_id long, bis_no int, l1_start int, l1_len int, l2_start int, l2_len int")
    m = spark.createDataFrame([rows[0], (1, 2, 2, 1, 1, 1)], g.schema)
    assert tuple(bitext.precision_recall(g, m).first()) == (2, 3, 2, 1.0, 0.666667, 0.8)
    assert bitext.breaks(m, spark.createDataFrame([(1, 2, 2)], "pair_id long, n1 int, n2 int")).collect() == [(1, "l2", 2)]


@OK
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=6))
def test_inversions_are_bubble_sort_swaps(scores):
    swaps, s = 0, list(scores)
    for i in range(len(s)):
        for j in range(len(s) - 1 - i):
            if s[j] < s[j + 1]:
                s[j], s[j + 1], swaps = s[j + 1], s[j], swaps + 1
    assert swaps == sum(scores[i] < scores[j] for i in range(len(scores)) for j in range(i + 1, len(scores)))


def test_badness_drops_nan(spark):
    cases = spark.createDataFrame([(1, [0.9, 0.5, 0.7, 0.1]), (2, [0.1, float("nan"), 0.0, 0.0])], "case_id int, s array<double>")
    assert segmenter.badness(cases).first()["n"] == 1
    assert segmenter.badness(cases).first()["badness"] == 1.0


def test_ranks_cross_ranges(spark):
    rows = spark.range(0, 500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 501).alias("x"))
    got = corpus.ranked(rows, "g", ["x"], "rank").collect()
    for g in range(3):
        own = sorted((r["x"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in own] == list(range(len(own)))


def test_near_duplicates_by_brute_force(spark):
    texts = ["aa bb cc dd ee ff gg hh", "aa bb cc dd ee ff gg hhh", "aa bb cc dd ee ff gg hh ii", "zz yy", "", None, "12 34"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    sets = {i: set(re.findall(r"[a-z]+", t)) for i, t in enumerate(texts) if t and re.findall(r"[a-z]+", t)}
    want = {(i, j) for i in sets for j in sets if (len(texts[i]), i) < (len(texts[j]), j) and len(texts[j]) < 1.2 * len(texts[i]) and len(sets[i] & sets[j]) * 100 > 85 * min(len(sets[i]), len(sets[j]))}
    assert {(r.i, r.j) for r in corpus.overlap_pairs(docs).collect()} == want


def test_neighbours_break_ties_by_id(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "wid long, v array<double>")
    got = lexical.top_neighbours(v.filter("wid = 1").select(F.col("wid").alias("qid"), F.col("v").alias("q")), v, 2).orderBy("rank").collect()
    assert [(r.wid, r.sim) for r in got] == [(2, 1.0), (1, 1.0)]
    assert v.select(V.cosine(F.col("v"), F.col("v")).alias("c")).filter("c is null").count() == 1


@pytest.mark.parametrize("kind", ["mono", "bilingual", "subwords"])
def test_training_lowers_the_loss(kind):
    rng = np.random.default_rng(0)
    docs = [rng.choice([0, 1, 2] if k % 2 else [3, 4, 5], 30) for k in range(40)]
    more = {"bilingual": {"targets": docs[::-1], "target_counts": np.full(6, 10.0)}, "subwords": {"parts": [(np.array([i, 6]), np.array([1.0, 0.5])) for i in range(6)]}}.get(kind, {})
    u, v, losses = lexical.train_sgns(docs, np.full(6, 10.0), dim=8, epochs=4, normalise="end", **more)
    assert losses[-1] < losses[0]
    assert np.allclose(np.linalg.norm(v, axis=1), 1)


def test_vectors_separate_planted_topics():
    rng = np.random.default_rng(0)
    docs = [rng.choice([0, 1, 2] if k % 2 else [3, 4, 5], 30) for k in range(200)]
    _, v, _ = lexical.train_sgns(docs, np.full(6, 10.0), dim=8, epochs=5, normalise="end")
    s = v @ v.T
    assert s[0, 1] > s[0, 4] and s[3, 5] > s[2, 5]


def test_entropy_peaks_and_subwords(spark):
    # After "un", and before "able", many letters follow or stand.
    words = [a + b for a in ("un", "re") for b in ("do", "tie", "fold", "happy", "able")] + ["do", "tie", "fold", "happy", "able", "doable", "foldable"]
    vocab = spark.createDataFrame([("en", w) for w in words], "lang string, tok string")
    cuts = {(r.tok, r.side, r.cut) for r in lexical.entropy_peaks(vocab).collect()}
    assert ("unhappy", "ahead", 3) in cuts and ("foldable", "behind", 5) in cuts
    found = {r.sw for r in lexical.peak_subwords(vocab).filter("tok = 'unhappy'").collect()}
    assert {"unhappy", "happy", "happy>", "<un"} <= found and "<unhappy>" not in found
    assert lexical.peak_subwords(vocab.limit(0)).count() == 0


def test_neighbours_by_method_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for i in range(30)] + [(30, [0.0] * 5, [0.0] * 5)]
    m = spark.createDataFrame(rows, "wid long, u array<double>, v array<double>")
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    got = lexical.most_similar(m.filter("wid < 5 or wid = 30").select(F.col("wid").alias("qid")), m, m, 4, ("U-V", "U+V")).collect()
    assert len(got) == 2 * 5 * 4 and all(r.wid != 30 for r in got)
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = sorted(((unit(rows[3][1]) @ unit(r[2]), r[0]) for r in rows[:30]), reverse=True)[:4]
    assert [r.wid for r in sorted(got, key=lambda r: r["rank"]) if r.method == "U-V" and r.qid == 3] == [w for _, w in want]


def test_models_round_trip_and_refuse_other_shapes(spark, tmp_path):
    v = spark.createDataFrame([("u", 1, [1.0, 2.0])], "space string, wid long, v array<double>")
    files.save_model(v, str(tmp_path / "m"), {"min_count": 3})
    assert files.load_model(spark, str(tmp_path / "m"), min_count=3)[0].collect() == v.collect()
    with pytest.raises(ValueError):
        files.load_model(spark, str(tmp_path / "m"), min_count=4)


def test_segments_keep_trailing_empties(spark):
    d = spark.createDataFrame([(1, "en", "a¤b¤")], "doc_id long, lang string, text string")
    assert [r.text for r in files.read_segmented(d).orderBy("seg_no").collect()] == ["a", "b", ""]


@pytest.mark.parametrize("kind", ["rf", "gbt", "ada"])
def test_segmenter_learns_full_stops(spark, kind):
    text = "Aa bb cc. Dd ee ff, gg hh. " * 6
    docs = spark.createDataFrame([(i, text.replace(". ", ".\n")) for i in range(3)], "doc_id long, text string")
    f = segmenter.boundary_features(docs, 2)
    trained = segmenter.train(f, kind)
    assert segmenter.scores(segmenter.predict(f, trained)).first()["f1"] > 0.9
    plain = segmenter.insert_boundaries(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))), lambda f: f[0] == ord("."), 2)
    assert plain.first()["text"].count("\n") >= 8


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "tok", "n", "freq", "drop_prob"]
