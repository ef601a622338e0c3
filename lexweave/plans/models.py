"""Registered queries over vector models, cross-language windows, benchmark cases and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import corpus, lexical, models, segmenter
from ..sources.files import store, table
from ..streaming import counts
from .catalogue import ORACLES, QUERIES, _BIS, _E, _TOKS, _TR, _VOC, _docs, _gold, _long, _made, _toks, _vectors, query

_TURNS = f"t AS (SELECT conv_id, turn, role, {_TOKS} AS toks FROM conversations)"
_EXCHANGES = f"{_TURNS}, x AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.conv_id AS doc, a.toks AS source, b.toks AS target FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


def _exchanges(spark, d):
    """(pair_id, doc, source, target): what a user said and the next turn, as tokens."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", T.tokens(F.lower("text")).alias("toks"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("target"))
    return t.filter("role = 'user'").join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("conv_id").alias("doc"), F.col("toks").alias("source"), "target")


@query("model_rows", f"WITH {_VOC} SELECT lang, tok, n, round(pow(n, 0.75), 6) AS smoothed, 1.0::DOUBLE AS norm_u, 1.0::DOUBLE AS norm_v FROM voc WHERE n >= 5")
def _(spark, d):
    m = models.new_model(corpus.vocabulary(_docs(spark, d)), 50, 5)
    return m.select("lang", "tok", "n", F.round("smoothed", 6).alias("smoothed"), F.round(V.norm(F.col("u")), 6).alias("norm_u"), F.round(V.norm(F.col("v")), 6).alias("norm_v"))


_HALF = "SELECT lang, tok, count(*) AS n FROM tr WHERE doc_id % 2 = {} GROUP BY lang, tok"


@query("grown_vocabulary", f"WITH {_TR}, a AS ({_HALF.format(0)}), b AS ({_HALF.format(1)}) SELECT lang, tok, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, a.n IS NULL AS fresh FROM a FULL JOIN b USING (lang, tok)")
def _(spark, d):
    half = lambda k: corpus.vocabulary(_docs(spark, d).filter(F.col("doc_id") % 2 == k)).select("lang", "tok", "n")
    old = models.new_model(half(0), 4)
    return models.grow(old, half(1), 4).join(old.select("lang", "tok", F.lit(True).alias("known")), ["lang", "tok"], "left").select("lang", "tok", "n", F.coalesce(~F.col("known"), F.lit(True)).alias("fresh"))


@query("fitted_vocabulary", f"WITH {_VOC}, {_TURNS}, ids AS (SELECT tok, row_number() OVER (ORDER BY first) - 1 AS old FROM voc WHERE lang = 'en'), c AS (SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM t) GROUP BY tok) SELECT tok, old, n, row_number() OVER (ORDER BY old) - 1 AS wid FROM c JOIN ids USING (tok)")
def _(spark, d):
    en = corpus.ranked(corpus.vocabulary(_docs(spark, d).filter("lang = 'en'")), "lang", ["doc", "pos"], "wid").select("lang", "tok", "wid")
    turns = table(spark, d, "conversations").select(F.explode(T.tokens(F.lower("text"))).alias("tok"))
    fitted = models.fit_vocabulary(en, turns).withColumn("lang", F.lit("en"))
    return corpus.ranked(fitted, "lang", ["old"], "wid").select("tok", _long("old"), "n", _long("wid"))


@query("identical_words", f"WITH {_VOC} SELECT a.tok, a.n AS n1, b.n AS n2 FROM voc a JOIN voc b USING (tok) WHERE a.lang = 'en' AND b.lang = 'fr' AND a.n >= 3")
def _(spark, d):
    return models.identical_words(corpus.vocabulary(_docs(spark, d)), "en", "fr", 3)


@query("transfer_matches", f"WITH {_VOC} SELECT a.lang, count(*) AS words, count(b.tok) AS matched FROM voc a LEFT JOIN (SELECT tok FROM voc WHERE lang = 'en') b USING (tok) WHERE a.lang <> 'en' GROUP BY a.lang")
def _(spark, d):
    m = models.new_model(corpus.vocabulary(_docs(spark, d)), 4).select("lang", F.col("tok").alias("word"), "v")
    moved = lexical.transfer(m.filter("lang <> 'en'").select("lang", "word", "v"), m.filter("lang = 'en'").select("word", "v"))
    return moved.groupBy("lang").agg(F.count("*").alias("words"), F.count_if("matched").alias("matched"))


@query("decoded_docs", f"WITH {_VOC} SELECT tr.doc_id, array_to_string(list(tr.tok ORDER BY tr.pos), ' ') AS text FROM tr JOIN voc ON tr.lang = voc.lang AND tr.tok = voc.tok AND voc.n >= 5 GROUP BY tr.doc_id")
def _(spark, d):
    docs = _docs(spark, d)
    v = store(corpus.ranked(corpus.vocabulary(docs).filter("n >= 5"), "lang", ["doc", "pos"], "wid").select("lang", "tok", "wid"), "vocab")
    encoded = store(lexical.encode_texts(_toks(docs), v), "encoded")
    return models.decode(encoded, v).select("doc_id", F.array_join("toks", " ").alias("text"))


@query("oov_tokens", f"WITH {_VOC}, {_TURNS} SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM t) WHERE tok NOT IN (SELECT tok FROM voc WHERE lang = 'en' AND n >= 3) GROUP BY tok")
def _(spark, d):
    known = corpus.vocabulary(_docs(spark, d).filter("lang = 'en'")).filter("n >= 3").select("tok")
    return table(spark, d, "conversations").select(F.explode(T.tokens(F.lower("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).join(known, "tok", "left_anti")


_S = "list_cosine_similarity({}, {})"


@query("compare_ranks", f"WITH e AS (SELECT vec_id AS wid, {_E} AS v FROM embeddings), q AS (SELECT a.wid AS w1, b.wid AS w2, a.v AS v1, b.v AS v2, {_S.format('a.v', 'b.v')} AS s FROM e a JOIN e b ON b.wid = a.wid + 1 WHERE a.wid % 100 = 0), m AS (SELECT w1, w2, s, e.wid, {_S.format('v1', 'e.v')} AS s1, {_S.format('v2', 'e.v')} AS s2 FROM q CROSS JOIN e) SELECT w1, w2, count(*) FILTER (s1 > s OR (s1 = s AND wid > w2)) + 1 AS there, count(*) FILTER (s2 > s OR (s2 = s AND wid > w1)) + 1 AS back FROM m GROUP BY w1, w2")
def _(spark, d):
    v = _vectors(spark, d).select("wid", "v")
    return models.compare_ranks(v.filter("wid % 100 = 0").select(F.col("wid").alias("w1"), (F.col("wid") + 1).alias("w2")), v)


@query("target_windows", f"WITH {_EXCHANGES}, i AS (SELECT pair_id, len(source) AS m, len(target) AS n, unnest(range(len(source))) AS i FROM x WHERE len(target) > 0), w AS (SELECT *, CASE WHEN n <= 11 THEN 0 ELSE greatest(i * n // m - 5, 0) END AS first, CASE WHEN n <= 11 THEN n ELSE least(i * n // m + 5, n) END AS last FROM i) SELECT pair_id, CAST(i AS INTEGER) AS i, CAST(first AS INTEGER) AS first, CAST(last - first AS INTEGER) AS size FROM w")
def _(spark, d):
    return models.target_windows(_exchanges(spark, d), 5)


@query("shifted_bisegments", f"WITH {_BIS} SELECT pair_id, bis_no, CASE WHEN bis_no > 2 THEN l1_start + 1 ELSE l1_start END AS l1_start, coalesce(CASE WHEN bis_no > 2 THEN l2_start + 2 ELSE l2_start END, -1) AS l2_start FROM gold")
def _(spark, d):
    return models.shift(_gold(spark, d), 2, 1, 2).select("pair_id", "bis_no", "l1_start", F.coalesce("l2_start", F.lit(-1)).alias("l2_start"))


@query("gold_not_made", f"WITH {_BIS}, made2 AS (SELECT * FROM made) SELECT pair_id, bis_no FROM gold g WHERE NOT EXISTS (SELECT 1 FROM made2 m WHERE m.pair_id = g.pair_id AND m.l1_start IS NOT DISTINCT FROM g.l1_start AND m.l1_len = g.l1_len AND m.l2_start IS NOT DISTINCT FROM g.l2_start AND m.l2_len = g.l2_len)")
def _(spark, d):
    g, m = _gold(spark, d).alias("g"), _made(spark, d).alias("m")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("l1_start", "l1_len", "l2_start", "l2_len")]
    on = F.col("g.pair_id") == F.col("m.pair_id")
    for s in same:
        on &= s
    return g.join(m, on, "left_anti").select("pair_id", "bis_no")


@query("length_correlation", "SELECT lang, round(corr(length(text), len(string_split(text, ' '))), 6) AS r, round(var_samp(ln(length(text))), 6) AS log_var FROM documents WHERE length(text) > 0 GROUP BY lang")
def _(spark, d):
    return _docs(spark, d).filter(F.length("text") > 0).groupBy("lang").agg(F.round(F.corr(F.length("text").cast("double"), F.size(F.split("text", " ", -1)).cast("double")), 6).alias("r"), F.round(F.var_samp(F.ln(F.length("text"))), 6).alias("log_var"))


@query("sentence_vectors", f"WITH {_VOC}, ids AS (SELECT tok, n, row_number() OVER (ORDER BY first) - 1 AS wid FROM voc WHERE lang = 'en'), f AS (SELECT tok, wid, n / sum(n) OVER () AS freq FROM ids), {_TURNS}, w AS (SELECT conv_id * 1000 + turn AS sent, unnest(toks) AS tok FROM t), j AS (SELECT sent, 0.001 / (0.001 + freq) AS a, {_E} AS e FROM w JOIN f USING (tok) JOIN embeddings ON vec_id = wid), u AS (SELECT sent, a, unnest(e) AS x, unnest(range(len(e))) AS dim FROM j) SELECT sent, CAST(dim AS INTEGER) AS dim, round(sum(a * x) / count(*), 6) AS x FROM u GROUP BY sent, dim")
def _(spark, d):
    return _sentence_vectors(spark, d).select("sent", F.posexplode("v").alias("dim", "x")).select("sent", "dim", F.round("x", 6).alias("x"))


def _sentence_vectors(spark, d):
    """Vectors of the turns, with the embeddings as those of the English vocabulary by id."""
    en = corpus.ranked(corpus.vocabulary(_docs(spark, d).filter("lang = 'en'")), "lang", ["doc", "pos"], "wid").select("tok", "n", F.col("wid").cast("long").alias("wid"))
    en = store(en, "vocab")
    total = en.agg(F.sum("n").alias("total"))
    weights = en.join(F.broadcast(total), F.lit(True)).select("wid", (F.col("n") / F.col("total")).alias("freq"))
    vectors = _vectors(spark, d).select("wid", F.col("v").cast("array<float>").alias("v"))
    # Words without a vector add nothing.
    having = store(en.select(F.lit("en").alias("lang"), "tok", "wid").join(vectors.select("wid").distinct(), "wid", "left_semi"), "having")
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit("en").alias("lang"), T.tokens(F.lower("text")).alias("toks"))
    sentences = store(lexical.encode_texts(turns, having).select(F.col("doc_id").alias("sent"), "ids"), "encoded")
    return lexical.sentence_vectors(sentences, vectors, weights)


_UNITS = "b AS (SELECT a.conv_id AS doc, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) - 1 AS k, a.turn FROM conversations a JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 1 WHERE a.role = 'user')"


def _units(spark, d):
    """(doc, k, turn): exchanges of a conversation in order."""
    x = _exchanges(spark, d).select("doc", (F.col("pair_id") % 1000).alias("turn"))
    return corpus.ranked(x, "doc", ["turn"], "k").select("doc", _long("k"), "turn")


@query("benchmark_cases", f"WITH {_UNITS}, r AS (SELECT doc, k, md5(doc || '-' || k) AS h, max(k) OVER (PARTITION BY doc) AS last FROM b), c AS (SELECT *, coalesce(lead(k) OVER w, first(k) OVER w) AS same, CASE WHEN k = 0 THEN 1 WHEN k = last THEN k - 1 WHEN h[1] >= '8' THEN k + 1 ELSE k - 1 END AS neighbour FROM r WHERE last > 0 WINDOW w AS (PARTITION BY doc ORDER BY h)), s AS (SELECT CAST('0x' || h[1:8] AS BIGINT) % 1024 AS bucket, min(doc) AS lo, max(doc) AS hi FROM r GROUP BY 1), m AS (SELECT c.*, CASE WHEN lo <> doc THEN lo ELSE hi END AS other FROM c JOIN s ON s.bucket = CAST('0x' || md5(doc || '+' || k)[1:8] AS BIGINT) % 1024) SELECT doc, k, neighbour, same, other FROM m WHERE other <> doc")
def _(spark, d):
    return models.benchmark_cases(_units(spark, d).select("doc", "k"))


@query("benchmark_badness")
def _(spark, d):
    """How often false partners score above better ones, over the cases of `benchmark_cases`."""
    u = store(_units(spark, d), "units")
    v = store(_sentence_vectors(spark, d), "sentences")
    turn = lambda off, doc, k, c: u.select(F.col("doc").alias(doc), F.col("k").alias(k), (F.col("doc") * 1000 + F.col("turn") + off).alias("sent")).join(v, "sent").select(doc, k, F.col("v").alias(c))
    cases = models.benchmark_cases(u.select("doc", "k")).withColumn("zero", F.lit(0).cast("long"))
    rows = cases.join(turn(0, "doc", "k", "s"), ["doc", "k"]).join(turn(1, "doc", "k", "t0"), ["doc", "k"])
    for c, doc, k in (("t1", "doc", "neighbour"), ("t2", "doc", "same"), ("t3", "other", "zero")):
        rows = rows.join(turn(1, doc, k, c), [doc, k])
    return segmenter.badness(rows.select(F.array(*[V.cosine(F.col("s"), F.col(f"t{i}")) for i in range(4)]).alias("s")))


@query("sgns_subwords")
def _(spark, d):
    docs = _docs(spark, d)
    vocab = store(corpus.ranked(corpus.vocabulary(docs).filter("n >= 20"), "lang", ["doc", "pos"], "wid").select("lang", "tok", "n", "wid"), "vocab")
    encoded = lexical.encode_texts(_toks(docs), vocab)
    return models.sgns_with_subwords(encoded, vocab)


@query("sgns_bilingual")
def _(spark, d):
    return models.sgns_bilingual(*_two_sides(spark, d))


def _two_sides(spark, d):
    """(pair_id, source, target), exchanges as ids, and (side, tok, n, wid)."""
    x = store(_exchanges(spark, d).select("pair_id", "source", "target"), "exchanges")
    side = lambda c, k: x.select(F.lit(k).alias("side"), F.explode(c).alias("tok")).groupBy("side", "tok").agg(F.count("*").alias("n"))
    vocab = store(corpus.ranked(side("source", 1).unionByName(side("target", 2)), "side", ["tok"], "wid").select("side", "tok", "n", _long("wid")), "vocab")
    named = vocab.select(F.col("side").cast("string").alias("lang"), "tok", "wid")
    ids = lambda c, k: lexical.encode_texts(x.select(F.col("pair_id").alias("doc_id"), F.lit(k).alias("lang"), F.col(c).alias("toks")), named).select(F.col("doc_id").alias("pair_id"), F.col("ids").alias(c))
    return ids("source", "1").join(ids("target", "2"), "pair_id"), vocab


@query("stream_vocab", f"WITH {_VOC} SELECT lang, tok, n FROM voc")
def _(spark, d):
    return counts.run_available(spark, f"{d}/document[s].parquet", "doc_id long, text string, lang string, source string, n_chars long")


def _peaks_sql(word: str, cut: str, side: str) -> str:
    """Peaks of one side: entropies of prefixes of `word`, of which a place has those before and after it."""
    rows = f"SELECT lang, tok, {word} AS w, unnest(range(1, length(tok) + 2)) AS k FROM voc"
    h = f"SELECT lang, prefix, round(abs(ln(sum(c)) - sum(c * ln(c)) / sum(c)), 9) AS h FROM (SELECT lang, substr(w, 1, k) AS prefix, substr(w, k + 1, 1) AS nxt, count(*) AS c FROM ({rows}) GROUP BY ALL) GROUP BY lang, prefix"
    at = f"SELECT r.lang, tok, k, length(w) AS n, h, lag(h) OVER o AS before, lead(h) OVER o AS after FROM ({rows}) r JOIN ({h}) e ON r.lang = e.lang AND substr(w, 1, k) = e.prefix WHERE length(tok) >= 4 WINDOW o AS (PARTITION BY r.lang, tok ORDER BY k)"
    return f"SELECT lang, tok, CAST({cut} AS BIGINT) AS cut, '{side}' AS side FROM ({at}) WHERE h > before AND h > after AND {cut} BETWEEN 2 AND n - 2"


@query("entropy_peaks", f"WITH {_VOC} {_peaks_sql("'<' || tok || '>'", 'k', 'ahead')} UNION ALL {_peaks_sql("reverse('<' || tok || '>')", 'n - k', 'behind')}")
def _(spark, d):
    return lexical.entropy_peaks(store(corpus.vocabulary(_docs(spark, d)), "vocab")).select("lang", "tok", _long("cut"), "side")


_SPACES = f"m AS (SELECT vec_id AS wid, vec_id % 2 AS lang, {_E} AS u, list_reverse({_E}) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(u, u)) AS nu FROM m), s AS (SELECT wid, lang, u, v, list_transform(range(1, len(u) + 1), lambda i: u[i] + v[i]) AS w FROM n)"
_COSINES = "SELECT '{0}' AS method, a.wid AS qid, b.wid, list_cosine_similarity(a.{1}, b.{2}) AS sim FROM s a JOIN s b ON a.wid % 100 = 0 AND {3}"


def _similar_sql(where: str) -> str:
    each = " UNION ALL ".join(_COSINES.format(m, x, y, where) for m, x, y in (("U-U", "u", "u"), ("U-V", "u", "v"), ("V-U", "v", "u"), ("V-V", "v", "v"), ("U+V", "w", "w")))
    return f"WITH {_SPACES} SELECT method, qid, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY sim DESC, wid DESC) AS rank FROM ({each})) WHERE rank <= 10"


def _spaces(spark, d):
    """The vectors as a model's two spaces: each, and the same read backwards."""
    return _vectors(spark, d).select("wid", F.col("v").alias("u"), F.reverse("v").alias("v"))


def _similar(m, own, others):
    found = lexical.most_similar(m.filter("wid % 100 = 0").select(F.col("wid").alias("qid")), own, others)
    return found.select("method", "qid", F.round("sim", 6).alias("sim"), _long("rank"))


@query("most_similar_methods", _similar_sql("true"))
def _(spark, d):
    m = _spaces(spark, d)
    return _similar(m, m, m)


@query("bilingual_most_similar", _similar_sql("a.lang = 0 AND b.lang = 1"))
def _(spark, d):
    m = _spaces(spark, d)
    return _similar(m, m.filter("wid % 2 = 0"), m.filter("wid % 2 = 1"))
