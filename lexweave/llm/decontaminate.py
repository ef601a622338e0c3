"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by token windows.

Texts are lower-cased over A-Z and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is
`width` consecutive words of an item; an item with fewer words is one window. The windows' hashes
meet each document's rolling window hashes in Python over Arrow batches, without a shuffle; each hit is
verified word by word against the item.

The hash set is sent to the executors, so its size is checked: beyond `block_windows` windows the
benchmark is scanned in several blocks, each within that bound, and the hits of the blocks are merged
by row. Null and empty texts have no words and no hits; repeated rows give repeated results; an empty
benchmark hits nothing; items without an id are left out. Columns of the input with other names
pass through `remove` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, as_bytes, read, slices, span_hash, windows, words

WIDTH = 8
MIN_ITEMS = 2
BLOCK_WINDOWS = 2_000_000

_HITS = "n_words long, items array<string>, spans array<bigint>"


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (item, words): the distinct windows of each item, its words joined by a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = words(data, at, NOT_ALNUM)
            raw, items, out = data.tobytes(), batch.column("item").to_pylist(), []
            for i, item in enumerate(items):
                own = [raw[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
                cut = {b" ".join(own[j : j + width]).decode() for j in range(max(1, len(own) - width + 1))} if own else set()
                out += [(item, x) for x in sorted(cut)]
            yield pa.RecordBatch.from_pydict({"item": pa.array([x[0] for x in out], pa.string()), "words": pa.array([x[1] for x in out], pa.string())})

    chosen = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null")
    return chosen.mapInArrow(run, "item string, words string").distinct()


class _Set:
    """Window hashes by number of words, with what each stands for."""

    def __init__(self, rows: list[tuple[str, str]]):
        found: dict[str, list[str]] = {}
        for item, text in rows:
            found.setdefault(text, []).append(item)
        self.texts, self.items = [x.encode() for x in found], list(found.values())
        data, at = as_bytes(pa.array(list(found), pa.string()))
        starts, ends, first = words(data, at, NOT_ALNUM)
        hashes, count = span_hash(data, starts, ends), np.diff(first)
        self.by_width = {}
        for k in sorted({int(x) for x in count}):
            own = np.flatnonzero(count == k)
            keys = np.array([windows(hashes[first[i] : first[i + 1]], np.array([0, k]), k)[0][0] for i in own], np.uint64)
            order = np.argsort(keys)
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.by_width[k] = (keys[order], own[order], seen)

    def hits(self, raw: bytes, starts, ends, hashes, first) -> list[tuple[int, int, int]]:
        """(first word, number of words, window) of each verified occurrence."""
        out = []
        for k, (keys, own, seen) in self.by_width.items():
            found, begins = windows(hashes, first, k)
            near = np.flatnonzero(seen[(found & np.uint64(0xFFFFF)).astype(np.int64)])
            at = np.searchsorted(keys, found[near])
            for j, p in zip(near, at, strict=True):
                while p < len(keys) and keys[p] == found[j]:
                    i = begins[j]
                    if b" ".join([raw[a:b] for a, b in zip(starts[i : i + k], ends[i : i + k], strict=True)]) == self.texts[own[p]]:
                        out.append((int(i), k, int(own[p])))
                    p += 1
        return out


def _scan(docs: DataFrame, found: _Set) -> DataFrame:
    """`docs` and n_words, items (distinct), spans: word ranges [from, to) that are hit, merged, as a flat list."""
    spark, names = docs.sparkSession, docs.columns
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch, data, at in slices(batches):
            data = LOWER[data]
            starts, ends, first = words(data, at, NOT_ALNUM)
            hashes = span_hash(data, starts, ends)
            items: list[set] = [set() for _ in range(batch.num_rows)]
            marks: list[list] = [[] for _ in range(batch.num_rows)]
            if hits := held.hits(data.tobytes(), starts, ends, hashes, first):
                rows = np.searchsorted(first, [i for i, _, _ in hits], "right") - 1
                for row, (i, k, w) in zip(rows, hits, strict=True):
                    items[row].update(held.items[w])
                    marks[row].append((int(i - first[row]), int(i - first[row]) + k))
            spans = [[x for pair in merge(m) for x in pair] for m in marks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], [*names, "n_words", "items", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {_HITS}")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """`docs` (which has `text`) with columns n_words, items and spans."""
    grams = benchmark_windows(benchmark, width)
    total = grams.count()
    blocks = max(1, -(-total // block_windows))
    if blocks == 1:
        return _scan(docs, _Set([tuple(x) for x in grams.collect()]))
    names = docs.columns
    parts = None
    for k in range(blocks):
        own = _Set([tuple(x) for x in grams.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()])
        one = _scan(docs, own)
        parts = one if parts is None else parts.unionByName(one)
    # Equal rows have equal hits, so that grouping by the whole row and repeating it is exact.
    grouped = parts.groupBy(*names).agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.collect_set("spans").alias("_s"), (F.count("*") / blocks).cast("int").alias("_n"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[x for pair in merge([(s[i], s[i + 1]) for s in many for i in range(0, len(s), 2)]) for x in pair] for many in batch.column("_s").to_pylist()]
            times = np.repeat(np.arange(batch.num_rows), batch.column("_n").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in [*names, "n_words", "items"]], pa.array(lists, pa.list_(pa.int64()))], [*names, "n_words", "items", "spans"]).take(pa.array(times))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return grouped.mapInArrow(run, f"{schema}, {_HITS}")


def remove(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, width: int = WIDTH) -> DataFrame:
    """`docs` without the documents in which windows of at least `min_items` items occur, or a hit span of `width` words or more.

    One full window is a leaked passage; one item of fewer words may well be chance.
    """
    inner = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    long_span = F.exists(F.sequence(F.lit(1), F.expr("size(spans) div 2")), lambda i: F.element_at("spans", (2 * i).cast("int")) - F.element_at("spans", (2 * i - 1).cast("int")) >= width)
    leaked = (F.size("items") >= min_items) | F.when(F.size("spans") > 0, long_span).otherwise(False)
    return scan(inner, benchmark, width).filter(~leaked).select("_row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` whose `text` has lost every hit span, from its first word's start to its last word's end."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches):
            starts, ends, first = words(LOWER[data], at, NOT_ALNUM)
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                keep, from_ = [], int(at[i])
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    keep.append(data[from_ : starts[first[i] + a]].tobytes())
                    from_ = int(ends[first[i] + b - 1])
                out.append(b"".join([*keep, data[from_ : at[i + 1]].tobytes()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_text"])

    inner = docs.select(F.struct(*[docs[n] for n in names]).alias("_row"), F.col("text").cast("string").alias("text"))
    kind = inner.schema["_row"].dataType.simpleString()
    cut = scan(inner, benchmark, width).mapInArrow(run, f"_row {kind}, _text string")
    return cut.select(*[F.when(F.col("_row.text").isNull(), None).otherwise(F.col("_text")).alias(n) if n == "text" else F.col(f"_row.`{n}`").alias(n) for n in names])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of `scan` over all documents: hits, items and the verdict of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items").to_pylist()
            spans = batch.column("spans").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([len(x) >= MIN_ITEMS for x in items], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
