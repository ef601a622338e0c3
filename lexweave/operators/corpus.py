"""Corpus statistics, ratios, filters, slices, vocabulary and near-duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import store


def token_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id, pos, tok), tokens in lower case."""
    return docs.select(*keys, "doc_id", F.posexplode(T.tokens(F.lower("text"))).alias("pos", "tok"))


def ranked(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """`df` with a 0-based rank within `group` by columns `order`, without meeting a group in one task.

    Rows are dealt by ranges of (group, order); ranks are counted within a range, and the ranges before it are added.
    """
    dealt = df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    dealt = store(dealt, "ranges")
    local = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1)
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select(group, "_range", "_before"), [group, "_range"]).withColumn(name, F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_before")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, tok, n, doc, pos): types with their counts and first occurrence."""
    rows = token_rows(docs, "lang").groupBy("lang", "tok")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
        if not ends["nulls"] and (ends["low"] is None or -(1 << 31) < ends["low"] <= ends["high"] < 1 << 31):
            # One long is aggregated by hash, two are sorted.
            seen = rows.agg(F.count("*").alias("n"), F.min(F.shiftleft(F.col("doc_id").cast("long"), 31) + F.col("pos")).alias("first"))
            return seen.select("lang", "tok", "n", F.shiftright("first", 31).alias("doc"), F.col("first").bitwiseAND((1 << 31) - 1).cast("int").alias("pos"))
    seen = rows.agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return seen.select("lang", "tok", "n", F.col("first.doc_id").alias("doc"), F.col("first.pos").alias("pos"))


def vocabulary_ids(docs: DataFrame) -> DataFrame:
    """(lang, tok, n, wid): ids in the order of first occurrence."""
    return ranked(vocabulary(docs), "lang", ["doc", "pos"], "wid").select("lang", "tok", "n", "wid")


def drop_probabilities(vocab: DataFrame, threshold: float, min_count: int) -> DataFrame:
    """Frequent types with their share and the chance that subsampling drops them."""
    total = vocab.groupBy("lang").agg(F.sum("n").alias("total"))
    share = vocab.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").withColumn("freq", F.col("n") / F.col("total"))
    return share.filter(F.col("n") >= min_count).withColumn("drop_prob", F.greatest(F.lit(0.0), 1 - F.sqrt(F.lit(threshold) / F.col("freq"))))


def document_stats(docs: DataFrame) -> DataFrame:
    """Counts of characters, tokens, table cells, numeric and alphabetic tokens, and the letters of the latter."""
    t = docs.withColumn("toks", T.tokens(F.col("text")))
    alpha = F.filter("toks", T.is_alpha)
    return t.select(*[c for c in docs.columns if c not in ("text", "n_chars")], F.length("text").cast("long").alias("num_chars"), F.size("toks").cast("long").alias("num_tokens"), F.regexp_count("text", F.lit(r"\|")).cast("long").alias("num_table_cells"), F.size(F.filter("toks", T.is_numeric)).cast("long").alias("num_numeric_tokens"), F.size(alpha).cast("long").alias("num_alphabetic_tokens"), F.aggregate(alpha, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("length_alphabetic_tokens"))


def pair_ratios(stats: DataFrame) -> DataFrame:
    """Ratios of documents 2k (first language) and 2k + 1 (second); null where a denominator is zero."""
    keyed = stats.withColumn("pair_id", F.expr("doc_id div 2"))
    l1 = keyed.filter("doc_id % 2 = 0").alias("a")
    l2 = keyed.filter("doc_id % 2 = 1").alias("b")
    r = lambda x, y: F.round(F.try_divide(x.cast("double"), y), 6)
    c = F.col
    return l1.join(l2, "pair_id").select("pair_id", r(c("a.num_numeric_tokens"), c("a.num_alphabetic_tokens")).alias("num_alpha_ratio"), r(c("a.num_numeric_tokens"), c("b.num_numeric_tokens")).alias("num_ratio"), r(c("a.num_chars"), c("b.num_chars")).alias("length_ratio"), r(c("a.num_alphabetic_tokens") + c("a.length_alphabetic_tokens"), c("b.num_alphabetic_tokens") + c("b.length_alphabetic_tokens")).alias("char_ratio"))


def type_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, types): distinct alphabetic tokens, case kept; documents without any are left out."""
    types = F.array_distinct(F.filter(T.tokens(F.col("text")), T.is_alpha))
    return docs.select("doc_id", "lang", F.length("text").alias("n_chars"), types.alias("types")).filter(F.size("types") > 0)


#: Counters of types by their hash, a power of two; documents of like length that are compared in one task.
SKETCH, CHUNK_DOCS = 1 << 22, 500


def overlap_pairs(docs: DataFrame, percent: int = 85, growth: float = 1.2) -> DataFrame:
    """(i, j, overlap): pairs of a language, n_chars of j below `growth` times that of i, with an overlap coefficient above percent / 100.

    The smaller set must share more than that part of itself, so one of any floor((1 - part) * k) + 1 of its
    types: the rarest, as a sketch counts them, probe an index of all types. Types are hashes there. A set goes to the chunks whose
    documents it met, documents of like length, so that of copies it goes to few; there the hashes are compared. Where
    any two types of the corpus have one hash, pairs are verified on the types too.
    """
    sets = type_sets(docs).filter("lang is not null").withColumn("hashes", F.array_sort(F.transform("types", lambda t: F.xxhash64("lang", t))))
    length = F.floor(F.ln(F.greatest("n_chars", F.lit(1)).cast("double")) * 20).cast("int")
    sets = store(sets.withColumn("length", length), "types")
    # Types of one hash are told apart by another one: of strings, the least and the greatest would have to be sorted.
    again = F.xxhash64(F.lit(1), "t", "lang")
    each = store(sets.select("lang", F.explode("types").alias("t")).groupBy(F.xxhash64("lang", "t").alias("h")).agg(F.count("*").alias("n"), F.min(again).alias("lo"), F.max(again).alias("hi")), "hashes")
    collide = each.filter("lo <> hi").limit(1).count()
    counted = each.groupBy(F.col("h").bitwiseAND(SKETCH - 1).cast("int").alias("slot")).agg(F.least(F.sum("n"), F.lit(1 << 30)).cast("int").alias("n")).toArrow()
    times = np.zeros(SKETCH, np.int32)
    times[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    kind = dict(sets.dtypes)["doc_id"]
    parts = F.broadcast(sets.groupBy("length").agg(F.ceil(F.count("*") / CHUNK_DOCS).cast("int").alias("parts")))
    dealt = store(sets.join(parts, "length").select("doc_id", "n_chars", "hashes", F.size("hashes").alias("k"), (F.col("length").cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("chunk")), "dealt")

    def run(batches):
        for batch in batches:
            lists = batch.column("hashes")
            h, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            n = times[h & (SKETCH - 1)]
            order = np.lexsort((h, n, row))
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h)) - (np.cumsum(size) - size)[row]
            probe = place <= size[row] * (100 - percent) // 100
            # A type of one document finds nobody.
            met = np.flatnonzero(n > 1)
            of = pa.array(row[met])
            yield pa.RecordBatch.from_arrays([pa.array(h[met]), *[batch.column(c).take(of) for c in ("doc_id", "n_chars", "k", "chunk")], pa.array(probe[met])], ["t", "id", "c", "k", "chunk", "probe"])

    postings = dealt.select("doc_id", "n_chars", "k", "hashes", "chunk").mapInArrow(run, f"t long, id {kind}, c int, k int, chunk long, probe boolean")
    side = lambda x, own, *more: own.select("t", *[F.col(y).alias(f"{x}{y}") for y in ("id", "k", "c", *more)])
    # Either of two sets of one size would find the other.
    near = (F.struct("pk", "pid") < F.struct("qk", "qid")) & (F.col("pid") != F.col("qid")) & (F.greatest("pc", "qc") < growth * F.least("pc", "qc"))
    met = side("p", postings.filter("probe")).join(side("q", postings, "chunk"), "t").filter(near)
    asked = store(met.select("pid", "qid", "qchunk").distinct().groupBy("pid", "qchunk").agg(F.collect_list("qid").alias("qids")), "asked")

    def compare(key: tuple, asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(own["doc_id"], range(len(own)), strict=True))
        hashes, chars = own["hashes"].tolist(), own["n_chars"].to_numpy()
        found = []
        for pid, c, h, qids in zip(asking["pid"], asking["pc"], asking["phashes"], asking["qids"], strict=True):
            rows = np.array([held[q] for q in qids])
            many = [hashes[r] for r in rows]
            sizes, flat = np.array([len(x) for x in many]), np.concatenate(many)
            shared = np.add.reduceat(h[np.minimum(np.searchsorted(h, flat), len(h) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
            least = np.minimum(sizes, len(h))
            for m in np.flatnonzero(shared * 100 > percent * least):
                found.append((pid, qids[m], c, chars[rows[m]], shared[m], least[m]))
        return pd.DataFrame(found, columns=["x", "y", "xc", "yc", "shared", "least"])

    asking = asked.join(dealt.select(F.col("doc_id").alias("pid"), F.col("n_chars").alias("pc"), F.col("hashes").alias("phashes")), "pid").select("qchunk", "pid", "qids", "pc", "phashes")
    both = asking.groupBy("qchunk").cogroup(dealt.select("chunk", "doc_id", "n_chars", "hashes").groupBy("chunk")).applyInPandas(compare, f"x {kind}, y {kind}, xc int, yc int, shared long, least long")
    both = both.withColumn("overlap", F.col("shared").cast("double") / F.col("least"))
    if collide:
        both = store(both, "near")
        own = lambda x: sets.select(F.col("doc_id").alias(x), F.col("types").alias(f"{x}s"))
        both = both.join(own("x"), "x").join(own("y"), "y").withColumn("overlap", T.overlap(F.col("xs"), F.col("ys"))).filter(F.size(F.array_intersect("xs", "ys")) * 100 > percent * F.col("least"))
    first = (F.col("xc") < F.col("yc")) | ((F.col("xc") == F.col("yc")) & (F.col("x") < F.col("y")))
    return both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("i"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("j"), F.when(first, F.col("yc")).otherwise(F.col("xc")).alias("jc"), F.round("overlap", 6).alias("overlap"))


def first_duplicates(pairs: DataFrame) -> DataFrame:
    """(i, j, overlap): of each document's longer near-duplicates the shortest, then of least id."""
    return pairs.groupBy("i").agg(F.min(F.struct("jc", "j", "overlap")).alias("m")).select("i", "m.j", "m.overlap")


def equal_slices(df: DataFrame, order: list, slices: int) -> DataFrame:
    """`df` with `slice`: so many runs of floor(n / slices) rows by `order`; rows left over go."""
    n = df.count()
    each = ranked(df.withColumn("_all", F.lit(0)), "_all", order, "_rn").drop("_all")
    return each.withColumn("slice", F.expr(f"_rn div {max(1, n // slices)}")).filter(F.col("slice") < slices).drop("_rn")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density) over [low, high], the last bin closed."""
    inside = df.filter(F.col(column).between(low, high))
    width = (high - low) / bins
    counted = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    total = inside.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("bin", "n", F.round(F.col("n") / (F.col("total") * width), 8).alias("density"))


def fitted_counts(df: DataFrame, group: str, column: str, values: int) -> DataFrame:
    """Of counts a group: how often a Poisson distribution of their mean expects 0, 1, ... (p0 ...), and the parameters of a gamma
    and a negative binomial distribution of their mean and variance. The last are null where the variance is not above the mean."""
    m = df.groupBy(group).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_samp(column).alias("var"))
    mean, var = F.col("mean"), F.col("var")
    expected = [F.round(F.col("n") * F.exp(k * F.ln(mean) - mean) / F.factorial(F.lit(k)), 6).alias(f"p{k}") for k in range(values)]
    gamma = [F.round(F.try_divide(mean * mean, var), 6).alias("gamma_shape"), F.round(F.try_divide(var, mean), 6).alias("gamma_scale")]
    wide = lambda c, n: F.round(F.when(var > mean, c), 6).alias(n)
    return m.select(group, *expected, *gamma, wide(mean * mean / (var - mean), "nb_size"), wide(mean / var, "nb_p"))


def exponential_fit(points: DataFrame) -> DataFrame:
    """One row (a, b): y = a * exp(-b * x) over the points (x, y) with y above 0, by least squares of its logarithm."""
    x, y = F.col("x").cast("double"), F.ln("y")
    return points.filter("y > 0").agg(F.exp(F.regr_intercept(y, x)).alias("a"), (-F.regr_slope(y, x)).alias("b"))
