"""Toxicity: a convolutional text classifier trained in NumPy, with thresholds calibrated by language.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Its embedding is the sum of four
rows of hashed tables: two for the word, one for each of its first 4 and 6 bytes, which inflected forms
share; filters of several widths slide over the whole text, the maximum of each over
all positions is kept, and a logistic layer gives the score. Labels, language, source and id are no
inputs of it. Language only chooses the threshold of `rejected`; `predicted` uses 0.5 for all.

The classifier learns from all labelled rows but a fifth, by hash of their ids, which sets the thresholds. The rows are dealt by hash
into shards of about SHARD rows. In each of ROUNDS every shard is learnt from the same weights, and the shards' weights are averaged by their
rows, those of a table's row over the shards that changed it. In how many texts a table's row occurs is counted over all
shards. Thresholds are chosen on a grid of 1 / GRID of the score's log odds, from counts of all rows set aside. All texts are scored.

Null and empty texts score as a text without words. A null id is no labelled row. Of repeated labels of
an id the highest counts; where ids repeat, every text of the id is an example. Without labels of both
kinds every score is the share of label 1, or 0. Other columns pass through `reject`.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, at_hand, discard, mapped, packed, read, slices, small_batches, span_hashes, store, words

FOLDS = 5
#: Rows of a shard, times that shards are averaged, and parts of a unit of log odds between thresholds.
SHARD, ROUNDS, GRID = 8192, 3, 64
DIM, BUCKETS, WIDTHS, FILTERS = 8, 1 << 16, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 32, 0.01
MIN_TEXTS = 3
MIN_CALIBRATION = 20
STEMS = (4, 6)
ROWS = 2 + len(STEMS)
_ROW = np.arange(ROWS)[:, None]
PAD = max(WIDTHS)
_SLICE = 1 << 18
#: Rows of texts in an Arrow batch.
BATCH_ROWS = 500


def word_rows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ROWS table rows for each word, of 16 bits, and `first` as in words()."""
    low = LOWER[data]
    starts, ends, first = words(low, at, NOT_ALNUM)
    whole, *stems = span_hashes(low, starts, ends, *[np.minimum(ends, starts + k) for k in STEMS])
    return np.stack([(x & np.uint64(BUCKETS - 1)).astype("<u2") for x in (whole, whole >> np.uint64(32), *stems)]), first


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of what word_rows gives, the rows and `place`: text i starts at place[i] and ends with PAD rows of zeros."""
    n = len(first) - 1
    place = first - first[0] + PAD * np.arange(n + 1)
    ids = np.full((ROWS, place[-1]), BUCKETS, np.int32)
    ids[:, np.arange(rows.shape[1]) + PAD * np.repeat(np.arange(n), np.diff(first))] = rows
    return ids, place


def token_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ROWS table rows for each word, and `place`, as padded() gives them."""
    return padded(*word_rows(data, at))


class Model:
    """Embedding table (its last row is zero), filters by width, and the logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((ROWS, BUCKETS + 1, DIM), np.float32)
        self.filters = [rng.normal(0, 0.7, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = np.full((len(WIDTHS), FILTERS), 0.1, np.float32)
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.constant: float | None = None
        self.thresholds: dict[str | None, float] = {}
        self.default = 0.5

    def embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[0][ids[0]]
        for table, row in zip(self.table[1:], ids[1:], strict=True):
            x += table[row]
        return x

    def parts(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.shift]

    def responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each width: the response at each place, without ReLU."""
        for k, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            r = np.zeros((len(x), FILTERS), np.float32)
            r += b
            for j in range(k):
                r[: len(x) - j] += x[j:] @ w[j]
            yield r

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0)
        ids, place = token_ids(data, at)
        x = self.embed(ids)
        edges = np.stack([place[:-1], place[1:] - PAD + 1], 1).ravel()
        pooled = np.concatenate([np.maximum.reduceat(r, edges)[::2] for r in self.responses(x)], 1)
        z = np.maximum(pooled, 0) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> np.ndarray:
        """texts: the table rows of each text; seen: in how many texts of all shards each row occurs. Returns which rows have changed.

        Adam on the log loss; only pooled places get gradients."""
        rng = np.random.default_rng(seed)
        # Rows of few texts keep their zeros: they'd be learnt by heart.
        rare = seen < MIN_TEXTS
        mean, square = [np.zeros_like(p) for p in self.parts()], [np.zeros_like(p) for p in self.parts()]
        table_square = np.zeros((ROWS, BUCKETS + 1), np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for chosen in np.array_split(order, max(1, len(order) // BATCH)):
                step += 1
                # Only these texts are padded: a shard of padded ones takes twice the room.
                ids, place = padded(np.concatenate([texts[i] for i in chosen], 1), np.concatenate(([0], np.cumsum([texts[i].shape[1] for i in chosen]))))
                ids = np.where(rare[_ROW, ids], BUCKETS, ids)
                x = self.embed(ids)
                best, value = [], []
                for r in self.responses(x):
                    at = np.stack([r[place[i] : place[i + 1] - PAD + 1].argmax(0) + place[i] for i in range(len(chosen))])
                    best.append(at)
                    value.append(r[at, np.arange(FILTERS)])
                pooled = np.maximum(np.concatenate(value, 1), 0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))
                err = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
                back = err[:, None] * self.out * (pooled > 0)
                grads, touched = [], []
                for k, width in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    dw = np.zeros_like(self.filters[k])
                    for j in range(width):
                        spot = best[k] + j
                        dw[j] = np.einsum("nf,nfd->df", g, x[spot])
                        touched.append((spot.ravel(), (g[:, :, None] * self.filters[k][j].T).reshape(-1, DIM)))
                    grads.append(dw)
                grads += [back.sum(0).reshape(self.bias.shape), err @ pooled, err.sum(keepdims=True)]
                for q, g, m, s in zip(self.parts(), grads, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                spot = np.concatenate([t[0] for t in touched])
                grad = np.concatenate([t[1] for t in touched])
                for h in range(ROWS):
                    rows, which = np.unique(ids[h][spot], return_inverse=True)
                    total = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(total, which, grad)
                    rows, total = rows[rows < BUCKETS], total[rows < BUCKETS]
                    table_square[h, rows] += (total**2).mean(1)
                    self.table[h, rows] -= 0.1 * total / (np.sqrt(table_square[h, rows])[:, None] + 1e-8)
        return table_square > 0

    def calibrate(self, level: np.ndarray, toxic: np.ndarray, count: np.ndarray, langs: list) -> None:
        """By language, and over all: the threshold with the highest F1, midway between neighbouring levels; of equal ones that nearest 0.5.

        level: log odds by GRID, of `count` rows, `toxic` of which have label 1.
        """
        self.default = _threshold(level, toxic, count)
        for lang in {x for x in langs}:
            own = np.array([x == lang for x in langs])
            if count[own].sum() >= MIN_CALIBRATION and 0 < toxic[own].sum() < count[own].sum():
                self.thresholds[lang] = _threshold(level[own], toxic[own], count[own])

    def cut(self, langs: list) -> np.ndarray:
        return np.array([self.thresholds.get(x, self.default) for x in langs])


def _threshold(level: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> float:
    if not len(level) or not 0 < toxic.sum() < count.sum():
        return 0.5
    own, which = np.unique(-level, return_inverse=True)
    s, hit, n = -own, np.cumsum(np.bincount(which, toxic)), np.cumsum(np.bincount(which, count))
    f1 = 2 * hit / (n + toxic.sum())
    middle = 1 / (1 + np.exp(-(s + np.append(s[1:], s[-1] - 1)) / (2 * GRID)))
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(middle[top[np.argmin(np.abs(middle[top] - 0.5))]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def texts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The table rows of each text, without a copy."""
    held = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return [flat[i:j].view("<u2").reshape(-1, ROWS).T for i, j in zip(at[:-1], at[1:], strict=True)]


def _seen(examples: DataFrame) -> np.ndarray:
    """In how many texts each table's row occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ROWS, BUCKETS + 1), np.int64)
        for batch in batches:
            for t in texts_of(batch):
                for h in range(ROWS):
                    sums[h, np.unique(t[h])] += 1
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"k": pa.array(own, pa.int64()), "n": pa.array(sums.ravel()[own])})

    with small_batches(examples.sparkSession, BATCH_ROWS):
        got = mapped(examples.select("ids"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ROWS * (BUCKETS + 1), np.int64)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(ROWS, BUCKETS + 1)


def _round(examples: DataFrame, model: Model, seen: np.ndarray, turn: int) -> None:
    """Moves `model` to the average of what the shards make of it."""
    shared = examples.sparkSession.sparkContext.broadcast((model, seen))
    columns = [f"x{d}" for d in range(DIM)]

    def learn(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        base, counts = shared.value
        own = copy.deepcopy(base)
        # A fixed order, whatever came first.
        texts = [t for batch in held for t in texts_of(batch)]
        names, labels = (np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("_id", "_y"))
        order = np.lexsort([[int(t.sum()) for t in texts], names])
        changed = np.flatnonzero(own.train([texts[i] for i in order], labels[order].astype(np.float64), counts, 7 + turn, EPOCHS // ROUNDS))
        flat = np.concatenate([x.ravel() for x in own.parts()])
        rest = np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)
        rows = np.concatenate([rest, own.table.reshape(-1, DIM)[changed]]).astype(np.float64)
        keys = np.concatenate([-1 - np.arange(len(rest)), changed])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), float(len(texts)))), *[pa.array(x) for x in (rows * len(texts)).T]], ["k", "n", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards follow one another. One that has grown, as ids repeat, is learnt in parts.
        held, size, now = [], 0, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and (shard[i] != now or size >= 2 * SHARD):
                    yield learn(held)
                    held, size = [], 0
                held.append(batch.slice(i, j - i))
                size, now = size + j - i, shard[i]
        if held:
            yield learn(held)

    each = mapped(examples.select("_id", "_y", "ids", "shard"), run, "k long, n double, " + ", ".join(f"{c} double" for c in columns))
    with small_batches(examples.sparkSession, BATCH_ROWS):
        got = each.groupBy("k").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in columns]).toArrow()
    keys, rows = got.column("k").to_numpy(), np.stack([got.column(c).to_numpy() for c in columns], 1)
    model.table.reshape(-1, DIM)[keys[keys >= 0]] = rows[keys >= 0]
    rest = rows[keys < 0][np.argsort(-keys[keys < 0])].ravel()
    first = 0
    for part in model.parts():
        part.ravel()[:] = rest[first : first + part.size]
        first += part.size
    shared.unpersist()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    known = store(known.groupBy("_id").agg(F.max("_y").alias("_y")), "known")
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    model = Model()
    if not (sizes.get(0) and sizes.get(1)):
        model.constant = float(sizes.get(1, 0) > 0)
        discard(known)
        return model
    text, lang = docs["text"].cast("string"), docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), text.alias("text"), lang.alias("lang")).join(at_hand(known), "_id").select("_id", "_y", "lang", "text")
    shards = -(-sum(sizes.values()) // SHARD)
    # A shard's rows move once, as texts, and lie in one file.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("_id"), "_id")

    names = ["_id", "_y", "lang", "shard"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches):
            ids, first = word_rows(data, at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], packed(ids.T.ravel(), ROWS * first)], [*names, "ids"])

    examples = store(mapped(rows, encode, "_id long, _y int, lang string, shard int, ids binary"), "examples", BATCH_ROWS)
    aside = F.pmod(F.xxhash64("_id"), F.lit(5)) == 0
    count = examples.agg(F.count_if(~aside).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("toxic"), F.count("*").alias("all"), F.coalesce(F.count_if(~aside & (F.col("_y") == 1)), F.lit(0)).alias("y")).first()
    if not 0 < count["y"] < count["n"]:
        model.constant = count["toxic"] / max(1, count["all"])
        discard(known, examples)
        return model
    learnt = examples.filter(~aside)
    seen = _seen(learnt)
    for turn in range(ROUNDS):
        _round(learnt, model, seen, turn)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array([_odds(shared.value, padded(t, np.array([0, t.shape[1]]))[0]) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(odds, -30, 30) * GRID).astype(np.int32)), batch.column("_y"), batch.column("lang")], ["level", "_y", "lang"])

    with small_batches(docs.sparkSession, BATCH_ROWS):
        got = mapped(examples.filter(aside).select("_y", "lang", "ids"), levels, "level int, _y int, lang string").groupBy("level", "lang").agg(F.sum("_y").alias("y"), F.count("*").alias("n")).toArrow()
    model.calibrate(got.column("level").to_numpy().astype(np.float64), got.column("y").to_numpy(), got.column("n").to_numpy(), got.column("lang").to_pylist())
    shared.unpersist()
    discard(known, examples)
    return model


def _odds(model: Model, ids: np.ndarray) -> float:
    pooled = np.concatenate([r[: ids.shape[1] - PAD + 1].max(0) for r in model.responses(model.embed(ids))])
    return float((np.maximum(pooled, 0) @ model.out + model.shift)[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (with `text` and `lang`, strings) with score, predicted (0.5) and rejected (the language's threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, data, at in slices(batches, most=_SLICE):
            s = own.score(data, at)
            rejected = s >= own.cut(batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32()), pa.array(rejected)], [*names, "score", "predicted", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, f"{schema}, score double, predicted int, rejected boolean")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with their columns as they were."""
    inner = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("_row"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    return score(inner, fit(docs, labels)).filter(~F.col("rejected")).select("_row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "rejected")
