import numpy as np
from pyspark.sql import functions as F

from lexweave.operators import lexical, models


def test_few_similarities_are_held_at_once():
    import pandas as pd

    batch = pd.DataFrame({"wid": range(5000), "v": [[1.0, 2.0]] * 5000})
    sizes = [len(w) for w, v in lexical.vector_slices([batch], 2000) if v.shape == (len(w), 2)]
    assert sum(sizes) == 5000 and max(sizes) * 2000 <= lexical.HELD_SIMS


def test_ranks_without_all_pairs_in_the_plan(spark):
    rows = [(i, [1.0, 3.0, 7.0]) for i in range(30)] + [(30, [0.0, 0.0, 0.0]), (31, [1.0, 3.0, 7.0000000001]), (32, [-1.0, 0.5, 0.1])]
    v = spark.createDataFrame(rows, "wid long, v array<double>")
    got = models.compare_ranks(spark.createDataFrame([(4, 9), (32, 5), (30, 3)], "w1 long, w2 long"), v)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    found = {(r.w1, r.w2): (r.there, r.back) for r in got.collect()}
    cos = lambda a, b: float(models.exact_cosines(np.array([a]), np.array([b]))[0])
    by = dict(rows)
    rank = lambda a, b: sum((cos(by[a], by[w]), w) > (cos(by[a], by[b]), b) for w in by) + 1
    assert found == {k: (rank(*k), rank(*k[::-1])) for k in [(4, 9), (32, 5), (30, 3)]}


def test_sentences_get_each_word_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_TOKENS", 4)
    s = spark.createDataFrame([(1, [0, 1, 1]), (2, [5]), (3, [1, 0, 7])], "sent long, ids array<long>")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 2.0]), (1, [0.25, 1.0])], "wid long, v array<float>")
    w = spark.createDataFrame([(0, 0.5), (1, 0.25)], "wid long, freq double")
    got = {r.sent: r.v for r in lexical.sentence_vectors(s, v, w).collect()}
    a, b = 0.001 / 0.501, 0.001 / 0.251
    assert set(got) == {1, 3} and np.allclose(got[1], [(a + 1.5 * b) / 5, 6 * b / 5]) and np.allclose(got[3], [(a + 0.75 * b) / 3, 3 * b / 3])
