from lexweave.operators import segmenter


def test_features_stay_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "Aa bb. Cc dd!\nEe ff (gg) hh. " * 3), (2, None), (3, "x"), (4, "Éé ßß. 𝔸b 12 ٣4.\nǅa ff gg hh ii")], "doc_id long, text string")
    f = segmenter.boundary_features(docs, 2)
    assert "Exchange" not in f._jdf.queryExecution().toString()
    text = "Aa bb. Cc dd!\nEe ff (gg) hh. " * 3
    rows = {(r.doc_id, r.i): r for r in f.collect()}
    want = [i for i, c in enumerate(text) if c in " \n" and 4 <= i < len(text) - 4 and not (c == " " and text[i - 1].isalpha() and text[i + 1].isalpha())]
    assert sorted(i for d, i in rows if d == 1) == want and {d for d, _ in rows} == {1, 4}
    first, later = text.index("\n"), text.index("(") - 1
    assert rows[1, first].label == 1 and rows[1, first].space == 32 and rows[1, later].distance == later - first
    assert rows[1, later].code1 == ord("(") and rows[1, later].class1 == 6 and rows[1, later].classm1 == 0


def test_a_long_text_takes_little_time(spark):
    import time

    docs = spark.createDataFrame([(1, "Aa bb, cc. " * 20_000)], "doc_id long, text string")
    segmenter.boundary_features(docs.limit(0)).count()
    began = time.time()
    assert segmenter.boundary_features(docs).count() > 30_000
    assert time.time() - began < 20
