"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared with the reference of
its language by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). The
references are the sums of the histograms of all documents of that language, so that every document
counts. A distance is tested only in documents long enough to have one: `min_chars` code points for
the classes, `min_words` words for the common words; shorter ones pass that test.

Base figures use words `[^\\x20\\x09-\\x0D]+`. A null text has none. A null or unseen language is a
language of its own. Repeated rows are judged alike and stay; ties do not arise, as no rows are ranked.
Columns with other names pass through `filter_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, SPACE, as_bytes, list_column, mix, read, slices, span_hash, store, windows, words

MIN_CHARS, MIN_WORDS = 500, 100
#: One distance alone this far, or both this far together.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.50
MAX_BOTH = (0.135, 0.25)
#: References are broadcast up to so many languages, and joined otherwise.
MAX_BROADCAST_LANGUAGES = 10_000

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you were "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden "
    "de la le et les en un du une que est pour qui dans par sur plus pas au avec "
    "el los se del las por con no su para al lo como más y a"
).split()

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Class of each byte; bytes that continue a character have none (-1).
CLASSES = np.full(256, 8, np.int8)
CLASSES[0x61:0x7B], CLASSES[0x41:0x5B], CLASSES[0x30:0x3A] = 0, 1, 2
CLASSES[list(b" \t\r\v\f")], CLASSES[0x0A] = 3, 4
CLASSES[list(b".,;:!?'\"()-")], CLASSES[list(b"#*$%&|<>")], CLASSES[list(b"/\\@[]{}_+=~^`")] = 5, 6, 7
CLASSES[0x80:0xC0], CLASSES[0xC2], CLASSES[0xC3:0xC5], CLASSES[0xC5:] = -1, 9, 10, 11
N_CLASSES = 12

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask)))
    return sums[at[1:]] - sums[at[:-1]]


def _keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))


def base_figures(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(at) - 1
    starts, ends, first = words(data, at, SPACE)
    chars = ((data & 0xC0) != 0x80) & ~SPACE[data]
    a, b, rows = words(data, at, np.arange(256) == 0x0A)
    row = np.repeat(np.arange(n), np.diff(rows))
    full = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, row = a[full], b[full], row[full]
    _, once = np.unique(_keyed(span_hash(data, a, b), row), return_index=True)
    dup = np.bincount(row, minlength=n) - np.bincount(row[once], minlength=n)
    word_row = np.repeat(np.arange(n), np.diff(first))
    found, begins = windows(span_hash(data, starts, ends), first, 8)
    _, which, times = np.unique(_keyed(found, word_row[begins]), return_inverse=True, return_counts=True)
    again = begins[times[which] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[again] += 1
    cover[again + 8] -= 1
    repeated = np.bincount(word_row[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [np.diff(first), _per_row(chars, at), _per_row(SYMBOLS[data], at), dup, repeated]


class _Common:
    def __init__(self):
        data, at = as_bytes(pa.array(COMMON_WORDS, pa.string()))
        keys = span_hash(data, at[:-1], at[1:])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of counts of the common words; the last column holds all others."""
        low = LOWER[data]
        starts, ends, first = words(low, at, NOT_ALNUM)
        short = np.flatnonzero(ends - starts <= 8)
        keys = span_hash(low, starts[short], ends[short])
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[place] == keys
        column = np.full(len(starts), len(self.keys))
        column[short[hit]] = self.order[place[hit]]
        width, n = len(self.keys) + 1, len(at) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        return np.bincount(row * width + column, minlength=n * width).reshape(n, width)


def histograms(docs: DataFrame) -> DataFrame:
    """`docs` (with `text` string) and the base figures, n_chars_all, classes and common (arrays of counts)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _Common()
        for batch, data, at in slices(batches):
            n = batch.num_rows
            kind = CLASSES[data]
            row = np.repeat(np.arange(n), np.diff(at))
            own = kind >= 0
            classes = np.bincount(row[own] * N_CLASSES + kind[own], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
            counted = common.count(data, at)
            arrays = [*batch.columns, *[pa.array(x, pa.int64()) for x in base_figures(data, at)], pa.array(classes.sum(1), pa.int64())]
            arrays += [list_column(x.ravel(), np.arange(n + 1) * x.shape[1], pa.int64()) for x in (classes, counted)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points", "classes", "common"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {_BASE}, n_points long, classes array<bigint>, common array<bigint>")


def references(found: DataFrame) -> DataFrame:
    """One row per language: the summed histograms of all its documents. Each task sends one row a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            both = [np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("classes", "common")]
            coded = batch.column("lang").dictionary_encode(null_encoding="encode")
            which = coded.indices.to_numpy()
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                own = np.concatenate([x[which == k].sum(0) for x in both])
                sums[lang] = sums.get(lang, 0) + own
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    parts = found.select("lang", "classes", "common").mapInArrow(run, "lang string, sums array<bigint>")
    each = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    whole = each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("all"))
    return whole.select("lang", F.slice("all", 1, N_CLASSES).alias("ref_classes"), F.slice("all", N_CLASSES + 1, len(COMMON_WORDS) + 1).alias("ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two arrays of counts; null where one is all zero."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    share = lambda x: F.transform(x, lambda v: F.try_divide(v.cast("double"), total(x)))
    half = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(share(a), share(b), lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2)))


def judge(docs: DataFrame) -> DataFrame:
    """`docs` (with `text` and `lang`, strings) and base figures, distances, base_failed, kept."""
    found = store(histograms(docs), "quality")
    refs = store(references(found), "quality-ref").withColumnRenamed("lang", "_lang")
    refs = F.broadcast(refs) if refs.count() <= MAX_BROADCAST_LANGUAGES else refs
    both = found.join(refs, found["lang"].eqNullSafe(refs["_lang"]), "left")
    far = both.select(*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points", js_distance(F.col("classes"), F.col("ref_classes")).alias("class_distance"), js_distance(F.col("common"), F.col("ref_common")).alias("word_distance"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    classes = F.when(F.col("n_points") >= MIN_CHARS, F.col("class_distance"))
    common = F.when(F.col("n_words") >= MIN_WORDS, F.col("word_distance"))
    diverges = (classes > MAX_CLASS_DISTANCE) | (common > MAX_WORD_DISTANCE) | ((classes > MAX_BOTH[0]) & (common > MAX_BOTH[1]))
    return far.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(diverges, F.lit(False)))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their columns as they were."""
    inner = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("_row"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    return judge(inner).filter("kept").select("_row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, distances and verdict of every document."""
    return judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance",
    )
