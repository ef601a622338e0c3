import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.functions import text as T
from lexweave.operators import bitext, lexical, models
from lexweave.sources import files
from lexweave.streaming import counts

SF = "/root/testdata/sf0.001"


def _vocab(spark, rows):
    return spark.createDataFrame(rows, "lang string, tok string, n long")


def test_new_rows_are_unit_and_repeatable(spark):
    v = _vocab(spark, [("en", "a", 5), ("en", "b", 1), ("fr", "a", 9)])
    one, two = (models.new_model(v, 8, 2, seed=3).orderBy("lang").collect() for _ in range(2))
    assert one == two and [r.tok for r in one] == ["a", "a"] and one[0].u != one[1].u
    assert all(math.isclose(sum(x * x for x in r[c]), 1) for r in one for c in ("u", "v"))
    assert one[0].smoothed == 5**0.75


def test_growth_keeps_rows_and_adds_words(spark):
    old = models.new_model(_vocab(spark, [("en", "a", 5), ("en", "b", 2)]), 4).cache()
    got = {r.tok: r for r in models.grow(old, _vocab(spark, [("en", "b", 3), ("en", "c", 7)]), 4).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 5, "b": 5, "c": 7}
    assert got["b"].u == old.filter("tok = 'b'").first().u and len(got["c"].u) == 4
    assert models.grow(old, _vocab(spark, []), 4).count() == 2


def test_ranks_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(40)]
    rows = [(i, v) for i, v in rows if any(v)]
    v = spark.createDataFrame(rows, "wid long, v array<double>")
    pairs = spark.createDataFrame([(rows[0][0], rows[1][0]), (rows[2][0], rows[9][0])], "w1 long, w2 long")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    by = dict(rows)
    rank = lambda a, b: sorted(((cos(by[a], by[w]), w) for w in by), reverse=True).index((cos(by[a], by[b]), b)) + 1
    for r in models.compare_ranks(pairs, v).collect():
        assert (r.there, r.back) == (rank(r.w1, r.w2), rank(r.w2, r.w1))


def test_target_windows(spark):
    words = lambda n: [str(i) for i in range(n)]
    p = spark.createDataFrame([(1, words(4), words(20)), (2, words(2), words(5)), (3, words(2), []), (4, [], words(9))], "pair_id long, source array<string>, target array<string>")
    got = sorted(map(tuple, models.target_windows(p, 2).collect()))
    assert got == [(1, 0, 0, 2), (1, 1, 3, 4), (1, 2, 8, 4), (1, 3, 13, 4), (2, 0, 0, 5), (2, 1, 0, 5)]


def test_shift_leaves_missing_sides(spark):
    b = spark.createDataFrame([(1, 1, 1), (2, 2, None), (3, None, 4)], "bis_no int, l1_start int, l2_start int")
    assert [tuple(r) for r in models.shift(b, 1, 1, 5).orderBy("bis_no").collect()] == [(1, 1, 1), (2, 3, None), (3, None, 9)]


def test_benchmark_cases_have_three_false_partners(spark):
    b = spark.createDataFrame([(d, k) for d in range(30) for k in range(d % 5)], "doc long, k long")
    rows = models.benchmark_cases(b, 4).collect()
    assert rows and all(r.same != r.k and r.other != r.doc and abs(r.neighbour - r.k) == 1 and 0 <= r.neighbour < r.doc % 5 and 0 <= r.same < r.doc % 5 for r in rows)


def test_stream_counts_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "docs")
    texts = ["a b a", "b c", "", None, "A d"]
    for i, t in enumerate(texts):
        spark.createDataFrame([("en", t)], "lang string, text string").coalesce(1).write.mode("append").parquet(path)
    got = {r.tok: r.n for r in counts.run_available(spark, path, "lang string, text string", files_each=2).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 1}


def test_decoding_is_the_inverse(spark):
    v = spark.createDataFrame([("en", "x", 0), ("en", "y", 1)], "lang string, tok string, wid int")
    e = spark.createDataFrame([(1, "en", [1, 0, 1])], "doc_id long, lang string, ids array<int>")
    assert models.decode(e, v).first().toks == ["y", "x", "y"]


@pytest.mark.parametrize("name", ["fitted_vocabulary", "decoded_docs", "oov_tokens", "sentence_vectors", "gold_not_made"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_training_learns(spark):
    rows = [(i, "en", [0, 1, 2, 3] * 8) for i in range(6)]
    e = spark.createDataFrame(rows, "doc_id long, lang string, ids array<long>")
    v = spark.createDataFrame([("en", i, t, 48) for i, t in enumerate(["walking", "walked", "walks", "cat"])], "lang string, wid long, tok string, n long")
    out = models.sgns_with_subwords(e, v, dim=6, least=2, epochs=2).collect()
    assert [r.wid for r in out[:4]] == [0, 1, 2, 3] and "<wal" in {r.sw for r in out} and all(len(r.u) == 6 for r in out)
    pairs = spark.createDataFrame([(i, [0, 1, 2], [2, 1, 0]) for i in range(8)], "pair_id long, source array<int>, target array<int>")
    n = spark.createDataFrame([(s, i, 8) for s in (1, 2) for i in range(3)], "side int, wid long, n long")
    assert models.sgns_bilingual(pairs, n, dim=4, window=2).groupBy("direction").agg(F.count("*")).count() == 2


def test_training_takes_all_documents_in_shards(spark):
    # 300 documents of words 0 and 1, and one alone that holds words 2 and 3.
    rows = [(i, "en", [0, 1] * 8) for i in range(300)] + [(300, "en", [2, 3] * 40)]
    e = spark.createDataFrame(rows, "doc_id long, lang string, ids array<long>")
    v = spark.createDataFrame([("en", i, n) for i, n in enumerate([2400, 2400, 40, 40])], "lang string, wid long, n long")
    for epochs in (1, 2):
        got = {r.wid: r for r in lexical.sgns_by_language(e, v, dim=4, epochs=epochs, tokens=1000).collect()}
        start, _, _ = lexical.train_sgns([], np.array([2400, 2400, 40, 40]), dim=4)
        assert sorted(got) == [0, 1, 2, 3] and all(np.abs(np.array(got[k].u) - start[k]).max() > 1e-3 for k in got)


@pytest.mark.parametrize("name", ["bisegment_tokens", "one_to_one", "missing_names", "copied_identical", "transferred_models", "words_with_subwords", "count_fits"])
def test_more_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got.select(names).collect()) == text(want.fetchall())


def test_texts_of_bisegments(spark):
    bis = spark.createDataFrame([(1, 1, 1, 2, 1, 1), (1, 2, None, 0, 2, 2), (2, 1, 1, 1, None, 0)], "pair_id long, bis_no int, l1_start int, l1_len int, l2_start int, l2_len int")
    segs = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 2, 1, None), (1, 2, 3, "z")], "pair_id long, side int, seg_no int, text string")
    got = {(r.pair_id, r.bis_no): (r.l1_text, r.l2_text) for r in bitext.with_texts(bis, segs).collect()}
    assert got == {(1, 1): ("a b", ""), (1, 2): ("", "z"), (2, 1): ("", "")}


def test_translations_by_frequency(spark):
    rows = [(k, "Ja ", t) for k in range(5) for t in ("yes", "aye")] + [(k, "ja", "YES") for k in range(4, 7)] + [(0, "nein", "no"), (9, "x" * 80, "no"), (9, None, "no")]
    pairs = bitext.short_pairs(spark.createDataFrame(rows, "doc long, s1 string, s2 string"))
    assert [tuple(r) for r in bitext.translations(pairs).collect()] == [("ja", 12, ["yes", "aye"])]


def test_saved_tables_refuse_damage(spark, tmp_path):
    v = spark.createDataFrame([("a", 2), ("b", 1)], "tok string, n long")
    files.save_vocabulary(v, str(tmp_path / "v"), {"lang": "en"})
    assert files.load_vocabulary(spark, str(tmp_path / "v"))[1] == {"lang": "en", "types": 2, "tokens": 3}
    v.limit(1).write.mode("overwrite").parquet(str(tmp_path / "v" / "words"))
    with pytest.raises(ValueError):
        files.load_vocabulary(spark, str(tmp_path / "v"))
    c = spark.createDataFrame([(1, [0, 1]), (2, None)], "doc_id long, ids array<int>")
    files.save_corpus(c, str(tmp_path / "c"), {}, 5)
    assert files.load_corpus(spark, str(tmp_path / "c"), 5)[1]["tokens"] == 2
    with pytest.raises(ValueError):
        files.load_corpus(spark, str(tmp_path / "c"), 3)
    (tmp_path / "names.json").write_text('["a_2004.xml", "b.xml"]')
    names = files.read_file_list(spark, str(tmp_path / "names.json"))
    assert [tuple(r) for r in names.select("file_name", T.year_of(F.col("file_name"))).orderBy("pos").collect()] == [("a_2004.xml", 2004), ("b.xml", None)]


def test_transfer_refuses_other_shapes(spark):
    m = spark.createDataFrame([("en", "a", 3, [1.0], [2.0])], "lang string, tok string, n long, u array<double>, v array<double>")
    with pytest.raises(ValueError):
        models.transfer_bilingual(m, m.withColumn("u", F.array(F.lit(1.0), F.lit(1.0))))
    with pytest.raises(ValueError):
        models.transfer_bilingual(m, m.withColumn("lang", F.lit("fr")))


def test_bilingual_training_with_subwords(spark):
    pairs = spark.createDataFrame([(i, [0, 1, 2], [2, 1, 0]) for i in range(8)], "pair_id long, source array<int>, target array<int>")
    n = spark.createDataFrame([(s, i, t, 8) for s in (1, 2) for i, t in enumerate(["walking", "walked", "cat"])], "side int, wid long, tok string, n long")
    out = models.sgns_bilingual(pairs, n, dim=4, window=2, subwords=True, least=2, epochs=2, tokens=20).collect()
    assert {r.sw for r in out if r.direction == 1 and r.sw} == {"<wal", "walk", "<walk"} and sum(r.wid is not None for r in out) == 6


def test_decimal_entities(spark):
    row = spark.createDataFrame([("&#233;&#xe9;&#9999999;&amp;#65;",)], "t string").select(T.replace_entities(F.col("t"))).first()
    assert row[0] == "éé&#9999999;&#65;"
