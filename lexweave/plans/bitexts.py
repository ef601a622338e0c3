"""Registered queries over bisegments' texts, file names, model transfer, saved tables and fitted distributions."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bitext, corpus, lexical, models
from ..sources import files
from ..sources.files import store, table
from .catalogue import _ALPHA, _BIS, _E, _P, _SEG, _STATS, _TR, _VOC, _docs, _gold, _long, _sentence_pairs, _toks, _vectors, query
from .models import _HALF, _exchanges, _two_sides

# Bisegments.

_SAID = "SELECT g.pair_id, g.bis_no, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS s FROM gold g LEFT JOIN conversations c ON conv_id = pair_id AND turn + 1 BETWEEN {0}_start AND {0}_start + {0}_len - 1 GROUP BY g.pair_id, g.bis_no"


@query("bisegment_tokens", f"WITH {_BIS}, a AS ({_SAID.format('l1')}), b AS ({_SAID.format('l2')}) SELECT a.pair_id, a.bis_no, length(a.s) AS l1_chars, length(a.s) - length(b.s) AS diff, CAST(len(regexp_extract_all(a.s, {_P})) AS BIGINT) AS l1_tokens, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(b.s), {_P}), lambda t: regexp_matches(t, {_ALPHA})))) AS BIGINT) AS l2_types FROM a JOIN b USING (pair_id, bis_no)")
def _(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("pair_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("side"), (F.col("turn") + 1).cast("int").alias("seg_no"), "text")
    x = bitext.with_texts(_gold(spark, d), turns)
    types = F.array_distinct(F.filter(T.tokens(F.lower("l2_text")), T.is_alpha))
    return x.select("pair_id", "bis_no", F.length("l1_text").cast("long").alias("l1_chars"), (F.length("l1_text") - F.length("l2_text")).cast("long").alias("diff"), F.size(T.tokens(F.col("l1_text"))).cast("long").alias("l1_tokens"), F.size(types).cast("long").alias("l2_types"))


@query("one_to_one", f"WITH {_SEG}, a AS (SELECT doc_id // 2 AS pair_id, seg_no FROM seg WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS pair_id, seg_no FROM seg WHERE doc_id % 2 = 1) SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.seg_no, b.seg_no) AS bis_no, coalesce(a.seg_no, -1) AS l1_start, CASE WHEN a.seg_no IS NULL THEN 0 ELSE 1 END AS l1_len, coalesce(b.seg_no, -1) AS l2_start, CASE WHEN b.seg_no IS NULL THEN 0 ELSE 1 END AS l2_len FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.seg_no = b.seg_no")
def _(spark, d):
    s = bitext.segments(_docs(spark, d)).select("doc_id", F.expr("doc_id div 2").alias("pair_id"), _long("seg_no"))
    x = bitext.one_to_one(s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1"))
    return x.select("pair_id", "bis_no", F.coalesce("l1_start", F.lit(-1)).alias("l1_start"), "l1_len", F.coalesce("l2_start", F.lit(-1)).alias("l2_start"), "l2_len")


@query("multi_translations", "WITH p AS (SELECT DISTINCT a.conv_id, lower(split_part(a.text, ' ', 1)) AS s1, lower(split_part(b.text, ' ', 1)) AS s2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'), c AS (SELECT s1, s2, count(*) AS n FROM p WHERE length(s1) < 70 AND length(s2) < 70 GROUP BY s1, s2 HAVING count(*) > 3) SELECT s1, CAST(sum(n) AS BIGINT) AS n, string_agg(s2, ' ' ORDER BY n DESC, s2) AS s2 FROM c GROUP BY s1")
def _(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.split_part("text", F.lit(" "), F.lit(1)).alias("s"))
    a, b = t.filter("role = 'user'").alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(F.col("a.conv_id").alias("doc"), F.col("a.s").alias("s1"), F.col("b.s").alias("s2"))
    return bitext.translations(bitext.short_pairs(p)).withColumn("s2", F.array_join("s2", " "))


@query("bisegment_totals", f"WITH {_BIS} SELECT count(*) AS bisegments, CAST(sum(l1_len) AS BIGINT) AS l1_segments, CAST(sum(l2_len) AS BIGINT) AS l2_segments, count(DISTINCT pair_id) AS pairs FROM gold")
def _(spark, d):
    return _gold(spark, d).agg(F.count("*").alias("bisegments"), F.sum("l1_len").cast("long").alias("l1_segments"), F.sum("l2_len").cast("long").alias("l2_segments"), F.countDistinct("pair_id").alias("pairs"))


@query("anchor_totals")
def _(spark, d):
    return bitext.anchor_totals(_sentence_pairs(spark, d), {}, [(1, 70, r"(.+)", "{}", (1,))])


# File names: the two documents of a pair differ in EN and HU alone.

_NAME = "'J' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN 'EN' ELSE 'HU' END || '_' || (2004 + (doc_id // 2) % 15) || '.xml'"


def _named(spark, d):
    mark = F.when(F.col("doc_id") % 2 == 0, "EN").otherwise("HU")
    name = F.concat(F.lit("J"), F.expr("doc_id div 2"), mark, F.lit("_"), 2004 + F.expr("doc_id div 2") % 15, F.lit(".xml"))
    return _docs(spark, d).withColumn("file_name", name)


@query("tokens_per_year", f"WITH {_STATS} SELECT coalesce(year, -1) AS year, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM (SELECT CAST(2004 + (doc_id // 2) % 15 AS INTEGER) AS year, num_tokens FROM st) GROUP BY ROLLUP (year)")
def _(spark, d):
    docs = _named(spark, d).select(T.year_of(F.col("file_name")).alias("year"), F.size(T.tokens(F.col("text"))).cast("long").alias("k"))
    return docs.rollup("year").agg(F.sum("k").alias("tokens")).fillna(-1, ["year"])


@query("name_pairs", f"WITH {_STATS}, n AS (SELECT doc_id, num_tokens, {_NAME} AS name FROM st) SELECT a.name AS en, b.name AS hu FROM n a JOIN n b ON replace(a.name, 'EN', '') = replace(b.name, 'HU', '') AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 WHERE a.num_tokens >= 10")
def _(spark, d):
    """Pairs by names without their language, of which the first has ten tokens or more."""
    x = _named(spark, d).select("file_name", F.regexp_replace("file_name", "EN|HU", "").alias("key"), F.size(T.tokens(F.col("text"))).alias("k"))
    side = lambda mark, c: x.filter(F.contains("file_name", F.lit(mark))).select("key", F.col("file_name").alias(c), "k")
    return side("EN", "en").filter("k >= 10").join(side("HU", "hu").drop("k"), "key").select("en", "hu")


@query("missing_names", f"WITH n AS (SELECT doc_id // 2 AS k, doc_id % 2 AS side, {_NAME} AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT name, CASE WHEN side = 0 THEN 'HU' ELSE 'EN' END AS missing FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.k = a.k AND b.side <> a.side)")
def _(spark, d):
    """Labelled files without their counterpart, in either direction."""
    x = _named(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("file_name").alias("name"), F.regexp_replace("file_name", "EN|HU", "").alias("key"))
    en, hu = (x.filter(F.contains("name", F.lit(m))) for m in ("EN", "HU"))
    lacks = lambda a, b, m: a.join(b.select("key"), "key", "left_anti").select("name", F.lit(m).alias("missing"))
    return lacks(en, hu, "HU").unionByName(lacks(hu, en, "EN"))


# Models.


def _halves(spark, d):
    """Models of the documents with even and with odd ids, whose vectors say how often a word occurs."""
    for k in (0, 1):
        v = corpus.vocabulary(_docs(spark, d).filter(F.col("doc_id") % 2 == k)).select("lang", "tok", "n")
        yield v.select("lang", "tok", "n", F.array(F.col("n").cast("double"), F.lit(float(k))).alias("u"), F.array(F.lit(float(k)), -F.col("n").cast("double")).alias("v"))


@query("copied_identical", f"WITH {_TR}, a AS ({_HALF.format(0)}) SELECT b.tok, CAST(coalesce(e.n, b.n) AS DOUBLE) AS u, CAST(-coalesce(e.n, b.n) AS DOUBLE) AS v, e.n IS NOT NULL AS copied FROM a b LEFT JOIN (SELECT tok, n FROM a WHERE lang = 'en' AND n >= 3) e USING (tok) WHERE b.lang = 'fr'")
def _(spark, d):
    m, _ = _halves(spark, d)
    return models.copy_identical(m, "en", "fr", 3).filter("lang = 'fr'").select("tok", F.col("u")[0].alias("u"), F.col("v")[1].alias("v"), "copied")


@query("transferred_models", f"WITH {_TR}, a AS ({_HALF.format(0)}), b AS ({_HALF.format(1)}) SELECT lang, count(*) FILTER (b.n IS NOT NULL AND a.n >= 2) AS trained, count(*) FILTER (b.n IS NULL AND a.n >= 2) AS untrained, CAST(sum(CASE WHEN a.n >= 2 THEN coalesce(b.n, a.n) ELSE a.n END) AS DOUBLE) AS total FROM a LEFT JOIN (SELECT * FROM b WHERE n >= 3) b USING (lang, tok) GROUP BY lang")
def _(spark, d):
    own, other = _halves(spark, d)
    m = models.transfer_bilingual(store(own, "own"), store(other, "other"), 2, 3)
    return m.groupBy("lang").agg(F.count_if("trained").alias("trained"), F.count_if(~F.col("trained") & (F.col("n") >= 2)).alias("untrained"), F.sum(F.col("u")[0]).alias("total"))


_W = "'<' || tok || '>'"
_GRAMS = f"ng AS (SELECT lang, tok, unnest(flatten(list_transform([4, 5, 6], lambda k: CASE WHEN length({_W}) > k THEN list_transform(range(1, length({_W}) - k + 2), lambda i: substr({_W}, i, k)) ELSE [] END))) AS sw FROM voc), sw AS (SELECT lang, sw FROM ng GROUP BY lang, sw HAVING count(*) >= 3), h AS (SELECT DISTINCT lang, tok FROM ng JOIN sw USING (lang, sw))"


@query("words_with_subwords", f"WITH {_VOC}, {_GRAMS} SELECT lang, tok, n, n >= 20 AS frequent, h.tok IS NOT NULL AS has_subwords FROM voc LEFT JOIN h USING (lang, tok) WHERE n >= 20 OR h.tok IS NOT NULL".replace("LEFT JOIN h USING (lang, tok)", "LEFT JOIN (SELECT lang AS hl, tok AS ht FROM h) h ON hl = lang AND ht = tok").replace("h.tok", "ht"))
def _(spark, d):
    return models.words_with_subwords(store(corpus.vocabulary(_docs(spark, d)), "vocab"), 20)


@query("summed_vectors", f"WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings), p AS (SELECT e.vec_id AS wid, s.vec_id AS sid, 1.0 / (1 + s.vec_id - e.vec_id) AS w FROM e JOIN e s ON s.vec_id BETWEEN e.vec_id AND e.vec_id + 2), x AS (SELECT wid, w, unnest(v) AS y, unnest(range(len(v))) AS dim FROM p JOIN e ON e.vec_id = sid) SELECT wid, CAST(dim AS INTEGER) AS dim, round(sum(w * y), 6) AS x FROM x GROUP BY wid, dim")
def _(spark, d):
    """Each vector with half of the next one and a third of the one after that."""
    v = _vectors(spark, d).select("wid", "v")
    parts = v.select("wid", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("wid", (F.col("wid") + F.col("k")).alias("sid"), (F.lit(1.0) / (1 + F.col("k"))).alias("weight"))
    return models.summed_vectors(v, parts, v.withColumnRenamed("wid", "sid")).select("wid", "dim", F.round("x", 6).alias("x"))


@query("model_summary", f"WITH {_VOC} SELECT lang, substr(md5(lang || '/16/5'), 1, 8) AS id, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n >= 5) AS kept_types, CAST(coalesce(sum(n) FILTER (n >= 5), 0) AS BIGINT) AS kept_tokens FROM voc GROUP BY lang")
def _(spark, d):
    kept = F.col("n") >= 5
    v = corpus.vocabulary(_docs(spark, d)).groupBy("lang").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.count_if(kept).alias("kept_types"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept_tokens"))
    return v.withColumn("id", models.model_id(F.concat("lang", F.lit("/16/5"))))


# Saved tables.


@query("saved_vocabulary", f"WITH {_VOC} SELECT lang, tok, n FROM voc")
def _(spark, d):
    path = f"{files.shared_dir(spark)}/saved-vocabulary-{uuid.uuid4().hex}"
    files.save_vocabulary(corpus.vocabulary(_docs(spark, d)).select("lang", "tok", "n"), path, {"lower": True})
    return files.load_vocabulary(spark, path)[0]


@query("saved_corpus", f"WITH {_VOC} SELECT doc_id, count(*) AS n FROM tr JOIN voc USING (lang, tok) WHERE n >= 5 GROUP BY doc_id")
def _(spark, d):
    docs = _docs(spark, d)
    v = store(corpus.ranked(corpus.vocabulary(docs).filter("n >= 5"), "lang", ["doc", "pos"], "wid").select("lang", "tok", "wid"), "vocab")
    path = f"{files.shared_dir(spark)}/saved-corpus-{uuid.uuid4().hex}"
    files.save_corpus(lexical.encode_texts(_toks(docs), v).select("doc_id", "ids"), path, {"lower": True}, 5)
    return files.load_corpus(spark, path, 5)[0].select("doc_id", F.size("ids").cast("long").alias("n"))


# Distributions.

_LINES = "c AS (SELECT lang, len(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)"
_MOMENTS = "m AS (SELECT lang, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM c GROUP BY lang)"
_EXPECTED = ", ".join(f"round(n * exp({k} * ln(mean) - mean) / {math.factorial(k)}, 6) AS p{k}" for k in range(7))


@query("count_fits", f"WITH {_LINES}, {_MOMENTS} SELECT lang, {_EXPECTED}, round(mean * mean / var, 6) AS gamma_shape, round(var / mean, 6) AS gamma_scale, round(CASE WHEN var > mean THEN mean * mean / (var - mean) END, 6) AS nb_size, round(CASE WHEN var > mean THEN mean / var END, 6) AS nb_p FROM m")
def _(spark, d):
    """Lines a document: counts that a Poisson distribution of their mean expects, gamma and negative binomial by moments."""
    x = _docs(spark, d).filter("text is not null").select("lang", F.size(F.split("text", "\n", -1)).alias("x"))
    return corpus.fitted_counts(x, "lang", "x", 7)


@query("decay_fit", "WITH h AS (SELECT CAST(floor(length(text) / 250.0) AS BIGINT) AS bin, count(*) AS n FROM documents WHERE length(text) < 2500 GROUP BY bin) SELECT round(exp(regr_intercept(ln(n), bin)), 6) AS a, round(-regr_slope(ln(n), bin), 6) AS b FROM h")
def _(spark, d):
    h = _docs(spark, d).filter(F.length("text") < 2500).groupBy(F.floor(F.length("text") / 250.0).alias("x")).agg(F.count("*").alias("y"))
    return corpus.exponential_fit(h).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("sgns_bilingual_subwords")
def _(spark, d):
    return models.sgns_bilingual(*_two_sides(spark, d), subwords=True)
