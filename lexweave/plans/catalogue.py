"""Registered queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import bitext, corpus, lexical, segmenter
from ..sources.files import store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The token pattern as DuckDB writes it, and parts of the SQL.
_P = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]'"
_TOKS = f"regexp_extract_all(lower(text), {_P})"
_RAW = f"regexp_extract_all(text, {_P})"
_TR = f"tr AS (SELECT lang, doc_id, unnest({_TOKS}) AS tok, unnest(range(len({_TOKS}))) AS pos FROM documents)"
_VOC = f"{_TR}, voc AS (SELECT lang, tok, count(*) AS n, min(doc_id * 10000000 + pos) AS first FROM tr GROUP BY lang, tok)"
_ALPHA = r"'^\p{L}+$'"
_STATS = (
    f"st AS (SELECT doc_id, lang, source, length(text) AS num_chars, len({_RAW}) AS num_tokens, length(text) - length(replace(text, '|', '')) AS num_table_cells, "
    rf"len(list_filter({_RAW}, lambda t: regexp_matches(t, '^\p{{N}}+$'))) AS num_numeric_tokens, len(list_filter({_RAW}, lambda t: regexp_matches(t, {_ALPHA}))) AS num_alphabetic_tokens, "
    f"coalesce(list_sum(list_transform(list_filter({_RAW}, lambda t: regexp_matches(t, {_ALPHA})), lambda t: length(t))), 0) AS length_alphabetic_tokens FROM documents)"
)
_SETS = f"sets AS (SELECT doc_id, lang, length(text) AS n_chars, list_distinct(list_filter({_RAW}, lambda t: regexp_matches(t, {_ALPHA}))) AS types FROM documents)"
_SEG = "seg AS (SELECT doc_id, lang, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seg_no, unnest(string_split(text, chr(10))) AS text FROM documents)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _toks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", T.tokens(F.lower("text")).alias("toks"))


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# Vocabulary.


@query("vocab_counts", f"WITH {_VOC} SELECT lang, tok, n FROM voc")
def _(spark, d):
    return corpus.vocabulary(_docs(spark, d)).select("lang", "tok", "n")


@query("vocab_ids", f"WITH {_VOC} SELECT lang, tok, n, row_number() OVER (PARTITION BY lang ORDER BY first) - 1 AS wid FROM voc")
def _(spark, d):
    return corpus.vocabulary_ids(_docs(spark, d)).select("lang", "tok", "n", _long("wid"))


@query("subsample_probs", f"WITH {_VOC} SELECT lang, tok, n, round(n / total, 9) AS freq, round(greatest(0, 1 - sqrt(0.001 / (n / total))), 6) AS drop_prob FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS total FROM voc) WHERE n >= 5")
def _(spark, d):
    out = corpus.drop_probabilities(corpus.vocabulary(_docs(spark, d)), 0.001, 5)
    return out.select("lang", "tok", "n", F.round("freq", 9).alias("freq"), F.round("drop_prob", 6).alias("drop_prob"))


@query("min_count_filter", f"WITH {_VOC} SELECT lang, count(*) AS kept, CAST(sum(n) AS BIGINT) AS tokens FROM voc WHERE n >= 3 GROUP BY lang")
def _(spark, d):
    return corpus.vocabulary(_docs(spark, d)).filter("n >= 3").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("tokens"))


@query("hapax", f"WITH {_VOC} SELECT lang, count(*) AS types, count(*) FILTER (n = 1) AS hapax FROM voc WHERE regexp_matches(tok, '^[\\p{{L}}\\p{{N}}]+$') GROUP BY lang")
def _(spark, d):
    return corpus.vocabulary(_docs(spark, d)).filter(F.col("tok").rlike(r"^[\p{L}\p{N}]+$")).groupBy("lang").agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"))


@query("top_types", f"WITH {_VOC} SELECT lang, tok, n FROM voc ORDER BY n DESC, lang, tok LIMIT 20")
def _(spark, d):
    return corpus.vocabulary(_docs(spark, d)).select("lang", "tok", "n").orderBy(F.desc("n"), "lang", "tok").limit(20)


@query("neg_sampling_cdf", f"WITH {_VOC}, w AS (SELECT lang, tok, first, pow(n, 0.75) AS w FROM voc WHERE n >= 5) SELECT lang, tok, round(sum(w) OVER (PARTITION BY lang ORDER BY first) / sum(w) OVER (PARTITION BY lang), 9) AS cdf FROM w")
def _(spark, d):
    v = corpus.vocabulary(_docs(spark, d)).filter("n >= 5").withColumn("w", F.pow("n", F.lit(0.75)))
    run = Window.partitionBy("lang").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return v.select("lang", "tok", F.round(F.sum("w").over(run) / F.sum("w").over(Window.partitionBy("lang")), 9).alias("cdf"))


# Document statistics.


@query("doc_stats", f"WITH {_STATS} SELECT doc_id, num_chars, num_tokens, num_table_cells, num_numeric_tokens, num_alphabetic_tokens, CAST(length_alphabetic_tokens AS BIGINT) AS length_alphabetic_tokens FROM st")
def _(spark, d):
    return corpus.document_stats(_docs(spark, d)).drop("lang", "source")


@query("totals_rollup", f"WITH {_STATS} SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS docs, CAST(sum(num_tokens) AS BIGINT) AS tokens, CAST(sum(num_chars) AS BIGINT) AS chars FROM st GROUP BY ROLLUP (source, lang)")
def _(spark, d):
    return corpus.document_stats(_docs(spark, d)).rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("num_tokens").alias("tokens"), F.sum("num_chars").alias("chars")).fillna("all", ["source", "lang"])


@query("min_tokens", f"WITH {_STATS} SELECT lang, min(num_tokens) AS least, min(num_chars) AS least_chars, count(*) FILTER (num_tokens < 10) AS short FROM st GROUP BY lang")
def _(spark, d):
    return corpus.document_stats(_docs(spark, d)).groupBy("lang").agg(F.min("num_tokens").alias("least"), F.min("num_chars").alias("least_chars"), F.count_if(F.col("num_tokens") < 10).alias("short"))


@query("files_diff", r"SELECT lang, count(*) AS n_all, count(*) FILTER (ok) AS n_kept, count(*) - count(*) FILTER (ok) AS diff FROM (SELECT lang, length(text) > 100 AND len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 20 AS ok FROM documents) GROUP BY lang")
def _(spark, d):
    ok = (F.length("text") > 100) & (F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))) > 20)
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_kept")).withColumn("diff", F.col("n_all") - F.col("n_kept"))


@query("describe_lengths", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std, min(length(text)) AS least, round(quantile_cont(length(text), 0.05), 6) AS p05, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.95), 6) AS p95, max(length(text)) AS most FROM documents GROUP BY lang")
def _(spark, d):
    x = _docs(spark, d).withColumn("x", F.length("text").cast("long"))
    p = lambda q, n: F.round(F.percentile("x", F.lit(q)), 6).alias(n)
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("least"), p(0.05, "p05"), p(0.5, "p50"), p(0.95, "p95"), F.max("x").alias("most"))


_SLICES = "sl AS (SELECT *, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // ((SELECT count(*) FROM documents) // 50) AS slice FROM (SELECT doc_id, length(text) AS n_chars, ln(1.0 + len(string_split(text, ' '))) AS y FROM documents))"


def _sliced(spark, d):
    x = _docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.ln(1.0 + F.size(F.split("text", " ", -1))).alias("y"))
    return corpus.equal_slices(x, ["n_chars", "doc_id"], 50)


@query("slice_stats", f"WITH {_SLICES} SELECT slice, count(*) AS n, round(median(n_chars), 6) AS mid, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std FROM sl WHERE slice < 50 GROUP BY slice")
def _(spark, d):
    return _sliced(spark, d).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.median("n_chars"), 6).alias("mid"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_samp("y"), 6).alias("std"))


@query("length_regression", f"WITH {_SLICES}, m AS (SELECT slice, median(n_chars) AS x, avg(y) AS y FROM sl WHERE slice < 50 GROUP BY slice) SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r FROM m")
def _(spark, d):
    m = _sliced(spark, d).groupBy("slice").agg(F.median("n_chars").alias("x"), F.avg("y").alias("y"))
    return m.agg(F.round(F.regr_slope("y", "x"), 9).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("length_histogram", "WITH x AS (SELECT length(text) AS v FROM documents WHERE length(text) BETWEEN 0 AND 5000) SELECT CAST(least(floor(v / 100.0), 49) AS BIGINT) AS bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM x) * 100.0), 8) AS density FROM x GROUP BY bin")
def _(spark, d):
    return corpus.histogram(_docs(spark, d).select(F.length("text").alias("v")), "v", 0.0, 5000.0, 50)


@query("char_diagnostics", r"SELECT lang, count(*) FILTER (regexp_matches(text, '\d\p{Lu}\p{Ll}')) AS glued, count(*) FILTER (contains(text, '|')) AS pipes, count(*) FILTER (contains(text, '¤')) AS marks FROM documents GROUP BY lang")
def _(spark, d):
    has = lambda c: F.count_if(F.contains("text", F.lit(c)))
    return _docs(spark, d).groupBy("lang").agg(F.count_if(F.col("text").rlike(r"\d\p{Lu}\p{Ll}")).alias("glued"), has("|").alias("pipes"), has("¤").alias("marks"))


# Pairs, joins and filters.

_PAIRS = (
    f"{_STATS}, pr AS (SELECT a.doc_id // 2 AS pair_id, round(a.num_numeric_tokens / nullif(a.num_alphabetic_tokens, 0), 6) AS num_alpha_ratio, round(a.num_numeric_tokens / nullif(b.num_numeric_tokens, 0), 6) AS num_ratio, round(a.num_chars / nullif(b.num_chars, 0), 6) AS length_ratio, "
    "round((a.num_alphabetic_tokens + a.length_alphabetic_tokens) / nullif(b.num_alphabetic_tokens + b.length_alphabetic_tokens, 0), 6) AS char_ratio FROM st a JOIN st b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1)"
)


@query("pair_ratios", f"WITH {_PAIRS} SELECT * FROM pr")
def _(spark, d):
    return corpus.pair_ratios(corpus.document_stats(_docs(spark, d)))


@query("ratio_filter", f"WITH {_PAIRS} SELECT pair_id, length_ratio FROM pr WHERE num_alpha_ratio < 0.3 AND length_ratio > 0.89 AND length_ratio < 1.25")
def _(spark, d):
    r = corpus.pair_ratios(corpus.document_stats(_docs(spark, d)))
    return r.filter("num_alpha_ratio < 0.3 and length_ratio > 0.89 and length_ratio < 1.25").select("pair_id", "length_ratio")


@query("outlier_pairs", f"WITH {_PAIRS} SELECT pair_id, length_ratio, length(b.text) AS l2_chars FROM pr JOIN documents b ON b.doc_id = pair_id * 2 + 1 WHERE length_ratio < 0.5")
def _(spark, d):
    r = corpus.pair_ratios(corpus.document_stats(_docs(spark, d))).filter("length_ratio < 0.5")
    b = _docs(spark, d).select(F.expr("doc_id").alias("id"), F.length("text").cast("long").alias("l2_chars"))
    return r.join(b, F.col("id") == F.col("pair_id") * 2 + 1).select("pair_id", "length_ratio", "l2_chars")


@query("pair_join", "SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l USING (doc_id)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("semi_keep", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("anti_missing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("set_operations", "SELECT 'except' AS op, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def _(spark, d):
    a, b = _docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda n, x: x.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n")
    return one("except", a.exceptAll(b).distinct()).unionByName(one("intersect", a.intersect(b))).unionByName(one("union", a.unionByName(b)))


_OV = f"{_SETS}, ov AS (SELECT a.doc_id AS i, b.doc_id AS j, b.n_chars AS jc, round(len(list_intersect(a.types, b.types)) / least(len(a.types), len(b.types)), 6) AS overlap FROM sets a JOIN sets b ON a.lang = b.lang AND (a.n_chars < b.n_chars OR (a.n_chars = b.n_chars AND a.doc_id < b.doc_id)) AND b.n_chars < 1.2 * a.n_chars AND len(a.types) > 0 AND len(b.types) > 0 WHERE len(list_intersect(a.types, b.types)) * 100 > 85 * least(len(a.types), len(b.types)))"


@query("near_duplicates", f"WITH {_OV} SELECT i, j, overlap FROM ov")
def _(spark, d):
    return corpus.overlap_pairs(_docs(spark, d)).select("i", "j", "overlap")


@query("first_duplicate", f"WITH {_OV} SELECT i, arg_min(j, jc * 1000000000 + j) AS j, arg_min(overlap, jc * 1000000000 + j) AS overlap FROM ov GROUP BY i")
def _(spark, d):
    return corpus.first_duplicates(corpus.overlap_pairs(_docs(spark, d)))


@query("keep_list", f"WITH {_OV} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT i FROM ov)")
def _(spark, d):
    return _docs(spark, d).select("doc_id").join(corpus.overlap_pairs(_docs(spark, d)).select(F.col("i").alias("doc_id")), "doc_id", "left_anti")


@query("language_overlap", f"WITH {_SETS} SELECT a.doc_id // 2 AS pair_id, round(len(list_intersect(a.types, b.types)) / least(len(a.types), len(b.types)), 6) AS similarity FROM sets a JOIN sets b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1 WHERE len(a.types) > 0 AND len(b.types) > 0 AND len(list_intersect(a.types, b.types)) * 2 < least(len(a.types), len(b.types))")
def _(spark, d):
    s = corpus.type_sets(_docs(spark, d))
    a, b = s.filter("doc_id % 2 = 0").alias("a"), s.filter("doc_id % 2 = 1").alias("b")
    both = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1).withColumn("o", T.overlap(F.col("a.types"), F.col("b.types"))).filter("o < 0.5")
    return both.select(F.expr("a.doc_id div 2").alias("pair_id"), F.round("o", 6).alias("similarity"))


# Segments and links.


@query("segments", f"WITH {_SEG} SELECT doc_id, seg_no, text, length(text) AS len FROM seg")
def _(spark, d):
    return bitext.segments(_docs(spark, d)).select("doc_id", _long("seg_no"), "text", _long("len"))


@query("combined_lengths", f"WITH {_SEG}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(text)) OVER w1 AS a, sum(length(text)) OVER w2 AS b, sum(length(text)) OVER w3 AS c FROM seg WINDOW w1 AS (PARTITION BY doc_id ORDER BY seg_no ROWS CURRENT ROW), w2 AS (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), w3 AS (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT doc_id, seg_no, CAST(a AS BIGINT) AS len1, CAST(CASE WHEN seg_no + 1 <= n THEN b ELSE 0 END AS BIGINT) AS len2, CAST(CASE WHEN seg_no + 2 <= n THEN c ELSE 0 END AS BIGINT) AS len3 FROM c")
def _(spark, d):
    return bitext.combined_lengths(bitext.segments(_docs(spark, d))).withColumn("seg_no", F.col("seg_no").cast("long"))


_NUMS = rf"list_distinct(list_concat(list_filter(list_transform({_RAW}, lambda t: lower(t)), lambda t: t IN ({', '.join(repr(x) for x in T.NUMBERING)})), list_filter({_RAW}, lambda t: regexp_matches(t, '^[\p{{L}}\p{{N}}]+$') AND NOT regexp_matches(t, {_ALPHA}))))"


@query("numbering_sets", f"WITH {_SEG} SELECT doc_id, seg_no, array_to_string(list_sort({_NUMS}), ' ') AS nums FROM seg WHERE len({_NUMS}) > 0")
def _(spark, d):
    s = bitext.segments(_docs(spark, d)).withColumn("nums", T.number_set(T.tokens(F.col("text"))))
    return s.filter(F.size("nums") > 0).select("doc_id", _long("seg_no"), F.array_join(F.array_sort("nums"), " ").alias("nums"))


@query("num_diff", f"WITH {_SEG}, s AS (SELECT doc_id, seg_no, {_NUMS} AS nums FROM seg) SELECT diff, count(*) AS n FROM (SELECT len(list_filter(a.nums, lambda x: NOT list_contains(b.nums, x))) + len(list_filter(b.nums, lambda x: NOT list_contains(a.nums, x))) AS diff FROM s a JOIN s b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1 AND a.seg_no = b.seg_no) GROUP BY diff")
def _(spark, d):
    s = bitext.segments(_docs(spark, d)).withColumn("nums", T.number_set(T.tokens(F.col("text")))).select("doc_id", "seg_no", "nums")
    a, b = s.filter("doc_id % 2 = 0").alias("a"), s.alias("b")
    both = a.join(b, (F.col("b.doc_id") == F.col("a.doc_id") + 1) & (F.col("a.seg_no") == F.col("b.seg_no")))
    return both.groupBy(T.symmetric_difference(F.col("a.nums"), F.col("b.nums")).cast("long").alias("diff")).agg(F.count("*").alias("n"))


# Bisegments by rule, from the conversations: turn 2k with 2k + 1, of growing ranges.
_BIS = (
    "gold AS (SELECT conv_id AS pair_id, CAST(turn + 1 AS INTEGER) AS bis_no, CAST(turn + 1 AS INTEGER) AS l1_start, CAST(1 AS INTEGER) AS l1_len, CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(turn + 1 AS INTEGER) END AS l2_start, CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 + CAST(turn % 2 AS INTEGER) END AS l2_len FROM conversations), "
    "made AS (SELECT pair_id, bis_no, l1_start, l1_len, l2_start, CASE WHEN l2_len > 0 AND (pair_id + bis_no) % 3 = 0 THEN 3 - l2_len ELSE l2_len END AS l2_len FROM gold)"
)


def _gold(spark, d):
    turns = table(spark, d, "conversations")
    t = (F.col("turn") + 1).cast("int")
    none = F.col("turn") % 5 == 4
    return turns.select(F.col("conv_id").alias("pair_id"), t.alias("bis_no"), t.alias("l1_start"), F.lit(1).alias("l1_len"), F.when(~none, t).alias("l2_start"), F.when(none, 0).otherwise(1 + F.col("turn") % 2).cast("int").alias("l2_len"))


def _made(spark, d):
    return _gold(spark, d).withColumn("l2_len", F.when((F.col("l2_len") > 0) & ((F.col("pair_id") + F.col("bis_no")) % 3 == 0), 3 - F.col("l2_len")).otherwise(F.col("l2_len")))


_LINKS = "links AS (SELECT pair_id, l1_start AS s1, unnest(CASE WHEN l2_len > 0 THEN range(l2_start, l2_start + l2_len) ELSE [NULL] END) AS s2 FROM {})"


@query("links", f"WITH {_BIS}, {_LINKS.format('gold')} SELECT pair_id, CAST(s1 AS BIGINT) AS s1, CAST(s2 AS BIGINT) AS s2 FROM links")
def _(spark, d):
    return bitext.individual_links(_gold(spark, d)).select("pair_id", _long("s1"), _long("s2"))


@query("link_types", f"WITH {_BIS} SELECT l1_len, l2_len, count(*) AS n, round(count(*) / (SELECT count(*) FROM gold), 6) AS share FROM gold GROUP BY l1_len, l2_len")
def _(spark, d):
    g = _gold(spark, d).groupBy("l1_len", "l2_len").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("link_marginals", f"WITH {_BIS} SELECT coalesce(l1_len, -1) AS l1_len, coalesce(l2_len, -1) AS l2_len, count(*) AS n FROM gold GROUP BY GROUPING SETS ((l1_len), (l2_len))")
def _(spark, d):
    g = _gold(spark, d)
    one = lambda c: g.groupBy(c).agg(F.count("*").alias("n"))
    return one("l1_len").withColumn("l2_len", F.lit(-1)).unionByName(one("l2_len").withColumn("l1_len", F.lit(-1))).select("l1_len", "l2_len", "n")


@query("diff_runs", f"WITH {_BIS}, missed AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.pair_id = g.pair_id AND m.l1_start IS NOT DISTINCT FROM g.l1_start AND m.l1_len = g.l1_len AND m.l2_start IS NOT DISTINCT FROM g.l2_start AND m.l2_len = g.l2_len)), i AS (SELECT pair_id, bis_no - row_number() OVER (PARTITION BY pair_id ORDER BY bis_no) AS island FROM missed) SELECT run_len, count(*) AS n FROM (SELECT count(*) AS run_len FROM i GROUP BY pair_id, island) GROUP BY run_len")
def _(spark, d):
    return bitext.difference_runs(_gold(spark, d), _made(spark, d))


@query("precision_recall", f"WITH {_BIS}, {_LINKS.format('gold').replace('links', 'g')}, {_LINKS.format('made').replace('links', 'm')}, c AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM m)) AS tp, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS n_gold, (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS n_made) SELECT tp, n_gold, n_made, round(tp / n_made, 6) AS precision, round(tp / n_gold, 6) AS recall, round(2 * tp / (n_gold + n_made), 6) AS f1 FROM c")
def _(spark, d):
    return bitext.precision_recall(_gold(spark, d), _made(spark, d))


@query("contiguity", f"WITH {_BIS}, r AS (SELECT *, lag(l2_start + l2_len) OVER w AS before, lead(1) OVER w AS after, max(bis_no) OVER (PARTITION BY pair_id) + 1 AS n2 FROM (SELECT *, max(bis_no) OVER (PARTITION BY pair_id) AS top FROM gold) WHERE l2_len > 0 WINDOW w AS (PARTITION BY pair_id ORDER BY bis_no)) SELECT pair_id, 'l2' AS side, bis_no FROM r WHERE l2_start <> coalesce(before, 1) OR (after IS NULL AND l2_start + l2_len <> top + 1)")
def _(spark, d):
    g = _gold(spark, d)
    return bitext.breaks(g, g.groupBy("pair_id").agg(F.max("bis_no").alias("n1"), F.max("bis_no").alias("n2"))).filter("side = 'l2'")


@query("diagonal_drift", f"WITH {_BIS} SELECT pair_id, CAST(min(l1_start - l2_start - l2_len) AS BIGINT) AS least, CAST(max(l1_start - l2_start - l2_len) AS BIGINT) AS most FROM gold WHERE l2_len > 0 GROUP BY pair_id")
def _(spark, d):
    x = F.col("l1_start") - F.col("l2_start") - F.col("l2_len")
    return _gold(spark, d).filter("l2_len > 0").groupBy("pair_id").agg(F.min(x).cast("long").alias("least"), F.max(x).cast("long").alias("most"))


@query("short_pair_mining", "WITH p AS (SELECT DISTINCT a.conv_id, lower(split_part(a.text, '.', 1)) AS s1, lower(split_part(b.text, '.', 1)) AS s2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user') SELECT s1, s2, count(*) AS n FROM p WHERE length(s1) < 70 AND length(s2) < 70 GROUP BY s1, s2")
def _(spark, d):
    t = table(spark, d, "conversations").withColumn("s", F.lower(F.split_part("text", F.lit("."), F.lit(1))))
    a, b = t.filter("role = 'user'").alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select("a.conv_id", F.col("a.s").alias("s1"), F.col("b.s").alias("s2")).distinct()
    return p.filter((F.length("s1") < 70) & (F.length("s2") < 70)).groupBy("s1", "s2").agg(F.count("*").alias("n"))


def _sentence_pairs(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text")).filter("role in ('user', 'assistant')")
    return t.select(F.col("conv_id").alias("pair_id"), F.when(F.col("role") == "user", 1).otherwise(2).alias("side"), F.posexplode(F.split("text", r"(?<=\.)\s")).alias("seg_no", "text"))


@query("align_pairs")
def _(spark, d):
    return bitext.align(_sentence_pairs(spark, d))


@query("align_cost")
def _(spark, d):
    return bitext.align(_sentence_pairs(spark, d), numbering=False).groupBy("pair_id").agg(F.count("*").alias("bisegments"), F.round(F.try_divide(F.max("cost"), F.count("*")), 6).alias("cost_each"), F.count_if((F.col("l1_len") == 1) & (F.col("l2_len") == 1)).alias("one_to_one"))


# Subwords.

_W = "'<' || tok || '>'"
_NG = f"ng AS (SELECT lang, n, unnest(flatten(list_transform([4, 5, 6], lambda k: CASE WHEN length({_W}) > k THEN list_transform(range(1, length({_W}) - k + 2), lambda i: substr({_W}, i, k)) ELSE [] END))) AS sw FROM voc)"


@query("subword_counts", f"WITH {_VOC}, {_NG} SELECT lang, sw, count(*) AS types, CAST(sum(n) AS BIGINT) AS total FROM ng GROUP BY lang, sw HAVING count(*) >= 3")
def _(spark, d):
    return lexical.subword_counts(corpus.vocabulary(_docs(spark, d)))


@query("subword_weights", f"WITH {_VOC}, {_NG}, s AS (SELECT lang, sw, CAST(sum(n) AS DOUBLE) AS total FROM ng GROUP BY lang, sw HAVING count(*) >= 3) SELECT s.lang, sw, round(0.001 / (0.001 + total / t.n), 6) AS weight FROM s JOIN (SELECT lang, sum(n) AS n FROM voc GROUP BY lang) t ON s.lang = t.lang")
def _(spark, d):
    v = corpus.vocabulary(_docs(spark, d))
    t = v.groupBy("lang").agg(F.sum("n").alias("all"))
    return lexical.subword_counts(v).join(t, "lang").select("lang", "sw", F.round(0.001 / (0.001 + F.col("total") / F.col("all")), 6).alias("weight"))


def _entropy_sql(word: str) -> str:
    return f"WITH {_VOC}, w AS (SELECT lang, {word} AS w FROM voc), e AS (SELECT lang, w, unnest(range(1, length(w))) AS k FROM w), c AS (SELECT lang, substr(w, 1, k) AS prefix, substr(w, k + 1, 1) AS nxt, count(*) AS c FROM e GROUP BY ALL) SELECT lang, prefix, round(abs(ln(sum(c)) - sum(c * ln(c)) / sum(c)), 6) AS entropy FROM c GROUP BY lang, prefix"


@query("prefix_entropy", _entropy_sql(_W))
def _(spark, d):
    return lexical.branching_entropy(corpus.vocabulary(_docs(spark, d))).withColumn("entropy", F.round(F.abs("entropy"), 6))


@query("reverse_entropy", _entropy_sql(f"reverse({_W})"))
def _(spark, d):
    return lexical.branching_entropy(corpus.vocabulary(_docs(spark, d)), reverse=True).withColumn("entropy", F.round(F.abs("entropy"), 6))


# Vectors.

_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("wid"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("norm_stats", f"SELECT round(avg(n), 6) AS mean, round(max(n), 6) AS most, round(min(n), 6) AS least, round(median(n), 6) AS mid FROM (SELECT sqrt(list_sum(list_transform({_E}, lambda x: x * x))) AS n FROM embeddings)")
def _(spark, d):
    n = _vectors(spark, d).select(V.norm(F.col("v")).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.max("n"), 6).alias("most"), F.round(F.min("n"), 6).alias("least"), F.round(F.median("n"), 6).alias("mid"))


@query("topk_cosine", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS wid, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0) SELECT qid, wid, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, wid DESC) AS rank FROM s) WHERE rank <= 10")
def _(spark, d):
    v = _vectors(spark, d)
    out = lexical.top_neighbours(v.filter("wid % 100 = 0").select(F.col("wid").alias("qid"), F.col("v").alias("q")), v)
    return out.select("qid", "wid", F.round("sim", 6).alias("sim"), _long("rank"))


@query("centroid_by_label", f"SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS x FROM (SELECT label, unnest({_E}) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim")
def _(spark, d):
    return _vectors(spark, d).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", _long("dim")).agg(F.round(F.avg("x"), 6).alias("x"))


@query("case_badness", f"WITH c AS (SELECT a.vec_id AS case_id, list_transform([1, 2, 3, 4], lambda k: list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), CASE k WHEN 1 THEN b.e WHEN 2 THEN c.e WHEN 3 THEN d.e ELSE f.e END)) AS s FROM embeddings a JOIN (SELECT vec_id, {_E} AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1 JOIN (SELECT vec_id, {_E} AS e FROM embeddings) c ON c.vec_id = a.vec_id + 2 JOIN (SELECT vec_id, {_E} AS e FROM embeddings) d ON d.vec_id = a.vec_id + 3 JOIN (SELECT vec_id, {_E} AS e FROM embeddings) f ON f.vec_id = a.vec_id + 4) SELECT count(*) AS n, round(avg(s[1]), 6) AS mean0, round(avg(s[2]), 6) AS mean1, round(avg(s[3]), 6) AS mean2, round(avg(s[4]), 6) AS mean3, round(avg(CAST(s[1] < s[2] AS INTEGER) + CAST(s[1] < s[3] AS INTEGER) + CAST(s[1] < s[4] AS INTEGER) + CAST(s[2] < s[3] AS INTEGER) + CAST(s[2] < s[4] AS INTEGER) + CAST(s[3] < s[4] AS INTEGER)), 6) AS badness FROM c")
def _(spark, d):
    v = _vectors(spark, d).select("wid", "v")
    rows = v
    for k in range(1, 5):
        rows = rows.join(v.select((F.col("wid") - k).alias("wid"), F.col("v").alias(f"v{k}")), "wid")
    return segmenter.badness(rows.select("wid", F.array(*[V.cosine(F.col("v"), F.col(f"v{k}")) for k in range(1, 5)]).alias("s")))


# Markup.


@query("tags_seen", r"SELECT tag, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("entities_seen", r"SELECT entity, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all(html, '&([A-Za-z]+|#[0-9A-Fa-fxX]+);', 1)) AS entity FROM pages) GROUP BY entity")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("&([A-Za-z]+|#[0-9A-Fa-fxX]+);"), F.lit(1))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("clean_pages")
def _(spark, d):
    clean = F.trim(T.normalise_space(T.replace_entities(T.replace_tags(T.delete_elements(F.col("html"))))))
    long = lambda t: (F.length(t) > 100) & (F.size(F.filter(F.split(t, r"\W"), lambda x: x != "")) > 20)
    # A filter of the table would clean each page again for every mention of its text.
    return table(spark, d, "pages").select("page_id", F.explode(F.filter(F.array(clean), long)).alias("text"))


# Encoded corpora, training, segmentation.


@query("encoded_docs", f"WITH {_VOC}, ids AS (SELECT lang, tok, row_number() OVER (PARTITION BY lang ORDER BY first) - 1 AS wid FROM voc WHERE n >= 5) SELECT tr.doc_id, array_to_string(list(ids.wid ORDER BY tr.pos), ' ') AS ids FROM tr JOIN ids ON tr.lang = ids.lang AND tr.tok = ids.tok GROUP BY tr.doc_id")
def _(spark, d):
    docs = _docs(spark, d)
    v = store(corpus.ranked(corpus.vocabulary(docs).filter("n >= 5"), "lang", ["doc", "pos"], "wid").select("lang", "tok", "wid"), "vocab")
    return lexical.encode_texts(_toks(docs), v).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("context_pairs", f"WITH {_TR}, e AS (SELECT * FROM tr WHERE doc_id % 1 = 0) SELECT a.tok AS word, b.tok AS context, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 1 AND a.pos + 1 AND a.pos <> b.pos GROUP BY a.tok, b.tok")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", T.tokens(F.lower("text")).alias("ids"))
    return lexical.context_pairs(docs, 1).select(F.col("wid").alias("word"), F.col("cid").alias("context"), "n")


@query("sgns_train")
def _(spark, d):
    docs = _docs(spark, d)
    vocab = store(corpus.ranked(corpus.vocabulary(docs).filter("n >= 20"), "lang", ["doc", "pos"], "wid").select("lang", "tok", "n", "wid"), "vocab")
    encoded = lexical.encode_texts(_toks(docs), vocab)
    return lexical.sgns_by_language(encoded, vocab.select("lang", F.col("wid").cast("long").alias("wid"), "n"))


@query("boundary_features")
def _(spark, d):
    return segmenter.boundary_features(_docs(spark, d))


@query("segmenter_train")
def _(spark, d):
    f = store(segmenter.boundary_features(_docs(spark, d).withColumn("text", F.replace(F.col("text"), F.lit(". "), F.lit(".\n")))), "features")
    trained = segmenter.train(f.filter("doc_id % 2 = 0"))
    return segmenter.scores(segmenter.predict(f.filter("doc_id % 2 = 1"), trained))
