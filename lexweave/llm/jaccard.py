"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct shingles of `width` words `[^\\x20\\x09-\\x0D]+`, A-Z in
lower case (with fewer words: the whole sequence). Two documents link at a Jaccard similarity of
`percent` hundredths or more. Equal sets are one class, of equal signatures; the join works on classes.

1. All documents are counted into a sketch of fixed size, which orders shingles from rare to common.
   The order decides only the cost: any order gives the same links.
2. A set of n shingles linked to another shares at least t = ceil(percent * n / 100) of its own, so that
   their first n - t + L shingles in the common order share at least L. Each document chooses its own L:
   longer prefixes cost postings, but demand L shared ones, and at most (postings / L) others have as
   many. Of a pair the lower L is demanded. The smaller set of a pair needs only its first
   n - ceil(2 * percent * n / (100 + percent)) + L shingles.
3. Postings meet in the two rounds of `meeting.linked`, which lose no component and make no pairs
   inside a group that is joined already. Each set has a bitmap: every shingle flips one of its bits. Two
   bitmaps differ in at most as many bits as the sets do in shingles, so that no link is lost where pairs
   with more are dropped.
4. Candidates are verified on the whole texts of both, which are read again from the input by id and hash of the text, so
   that no second copy of all texts is stored. The input must give the same rows each time: store a costly one first.

Null texts and texts without words have empty sets, link with nothing and stay alone. A null id is no
smallest id unless all ids of the component are null. Repeated rows are copies. `one_of_each` keeps
all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, at_hand, discard, list_column, mapped, mix, read, signed, slices, small_batches, span_hash, store, windows, words
from .meeting import linked

WIDTH, PERCENT = 4, 85
SKETCH = 1 << 18
MOST_MATCHES = 8
#: Texts in an Arrow batch.
BATCH_ROWS = 1000
#: Cost of verifying a pair, in postings.
VERIFY = 8.0
#: Longs of a set's bitmap.
BITMAP = 4
BITS = [f"bits{k}" for k in range(BITMAP)]


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and `first` as in words()."""
    low = LOWER[data]
    starts, ends, first = words(low, at, SPACE)
    hashes, n = span_hash(low, starts, ends), len(at) - 1
    found, begins = windows(hashes, first, width)
    row = np.searchsorted(first, begins, "right") - 1
    count = np.diff(first)
    for k in range(1, width):
        for i in np.flatnonzero(count == k):
            one, _ = windows(hashes[first[i] : first[i + 1]], np.array([0, k]), k)
            found, row = np.append(found, mix(one + np.uint64(k))), np.append(row, i)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[keep], row[keep]
    return found, np.searchsorted(row, np.arange(n + 1))


def count_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of all documents' shingles in SKETCH counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for _, data, at in slices(batches):
            found, _ = shingle_sets(data, at, width)
            counts += np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(own, pa.int32()), "n": pa.array(counts[own], pa.int64())})

    with small_batches(docs.sparkSession, BATCH_ROWS):
        sums = mapped(docs.select("text"), run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return out


def prefix(counts: np.ndarray, percent: int) -> tuple[int, int]:
    """The number of demanded matches, and of shingles, for a set whose shingles have such counts, from rare to common."""
    n = len(counts)
    base = n - -(-percent * n // 100)
    most = min(MOST_MATCHES, n - base)
    sums = np.cumsum(counts[: base + most])[base:]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(sums * (1 + VERIFY / matches)))
    return best + 1, base + best + 1


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """For `docs` (rid, tid long, text string): uid (of the row), rid, tid, sig (of the set; null if empty), n, matches, prefix and bitmap.

    Row ids come from the task and its order of rows: the result must be stored before it is used twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.log2(1 + count_sketch(docs, width)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        noise = 2 ** float(np.median(logs))
        uid = TaskContext.get().partitionId() << 33
        for batch, data, at in slices(batches):
            found, first = shingle_sets(data, at, width)
            count = np.diff(first)
            row = np.repeat(np.arange(len(count)), count)
            rank = logs[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.lexsort((found, rank, row))
            ordered, load = found[order], np.maximum(2 ** rank[order].astype(np.float64) - noise, 1.0)
            full = np.flatnonzero(count)
            sums = [np.add.reduceat(x, first[full]) if len(full) else x for x in (found, mix(found ^ np.uint64(0x5851F42D4C957F2D)))]
            sigs, cuts, matches, size = [None] * len(count), [], np.zeros(len(count), np.int32), 0
            place = [0]
            pair = np.stack([*sums, count[full].astype(np.uint64)], 1).astype("<u8") if len(full) else np.zeros((0, 3), "<u8")
            for i, j in enumerate(full):
                sigs[j] = pair[i].tobytes()
            for i in range(len(count)):
                if count[i]:
                    matches[i], size = prefix(load[first[i] : first[i + 1]], percent)
                    cuts.append(ordered[first[i] : first[i] + size])
                    place.append(place[-1] + size)
                else:
                    place.append(place[-1])
            flat = np.concatenate(cuts) if cuts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(count))), batch.column("rid"), batch.column("tid"), pa.array(sigs, pa.binary()), pa.array(count, pa.int64()), pa.array(matches), list_column(signed(flat), np.array(place), pa.int64()), *[pa.array(x) for x in bitmaps(found, row, len(count)).T]], ["uid", "rid", "tid", "sig", "n", "matches", "prefix", *BITS])
            uid += len(count)

    return mapped(docs, run, "uid long, rid long, tid long, sig binary, n long, matches int, prefix array<bigint>, " + ", ".join(f"{c} long" for c in BITS))


def bitmaps(found: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n rows of BITMAP longs: the parity of the shingles of each bit."""
    bit = (mix(found) >> np.uint64(32)).astype(np.int64) % (64 * BITMAP)
    odd = np.bincount(row * (64 * BITMAP) + bit, minlength=n * 64 * BITMAP).reshape(n, 64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts link. texts: (id, text), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[(found[first[i] : first[i + 1]]) for part, data, at in slices(iter([batch]), c) for found, first in [shingle_sets(data, at, width)] for i in range(part.num_rows)] for c in ("text_a", "text_b")]
            keep = []
            for x, y in zip(*sides, strict=True):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return store(mapped(with_b.select("a", "b", "text_a", "text_b"), run, "a long, b long"), "links", 200)


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows (rid, tid, n, group) for docs (rid long, text string): tid the hash of the text, the size of the set and a number of the component, null for empty sets."""
    named = docs.select("rid", F.xxhash64("text").alias("tid"), "text")
    rows = store(signatures(named, width, percent), "jaccard", BATCH_ROWS)
    classes = rows.filter("sig is not null").groupBy("sig").agg(F.min("uid").alias("id"), *[F.first(c).alias(c) for c in ("n", "matches", "prefix", *BITS)])
    classes = store(classes, "classes")
    indexed = F.col("pos") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent) - 1e-9) + F.col("matches")
    postings = classes.select(F.posexplode("prefix").alias("pos", "token"), "id", "n", "matches").select("token", "id", F.col("n").cast("int").alias("size"), "matches", indexed.alias("indexed"), "pos")

    def verify(pairs: DataFrame) -> DataFrame:
        # An id is a row's, so that no class of many copies meets in one task.
        # Stored, so that its size is known before the join: while it is small, no other text moves.
        asked = store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
        wanted = store(rows.select(F.col("uid").alias("id"), "rid", "tid").join(at_hand(asked), "id"), "wanted")
        # Repeated rows have the same id and text: one of them is enough.
        texts = store(named.join(at_hand(wanted), ["rid", "tid"]).groupBy("id").agg(F.first("text").alias("text")), "texts")
        out = verified(pairs, texts, width, percent)
        discard(asked, wanted, texts)
        return out

    most = lambda x, y: F.lit(100 - percent) * (x + y) / (100 + percent) + 1e-9
    final = linked(postings, classes.select("id", *BITS), verify, percent, True, most).withColumnsRenamed({"node": "id", "component": "group"})
    groups = classes.select("sig", "id").join(final, "id", "left").select("sig", F.coalesce("group", "id").alias("group"))
    return rows.select("rid", "tid", "sig", "n").join(groups, "sig", "left").select("rid", "tid", "n", "group")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as a long that is never null."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("rid"), docs["text"].cast("string").alias("text"))


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id)."""
    found = store(join(_keyed(docs), width, percent).select("rid", "n", "group"), "groups")
    least = found.filter("group is not null").groupBy("group").agg(F.min("rid").alias("least"))
    out = found.join(least, "group", "left").select(F.col("rid"), "n", F.coalesce("least", "rid").alias("least"))
    shown = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return out.select(shown("rid").alias("doc_id"), F.col("n").alias("n_shingles"), shown("least").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The row of `docs` with the least id, then hash of its text, of each group, and of those without words one of each id and text."""
    columns = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("rid"), docs["text"].cast("string").alias("text"))
    found = store(join(rows.select("rid", "text"), width, percent), "groups")
    least = found.filter("group is not null").groupBy("group").agg(F.min(F.struct("rid", "tid")).alias("k")).select("k.*")
    keep = least.unionByName(found.filter("group is null").select("rid", "tid")).distinct()
    return rows.withColumn("tid", F.xxhash64("text")).join(keep, ["rid", "tid"]).groupBy("rid", "tid").agg(F.first("_row").alias("_row")).select("_row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
