"""Sentence boundaries: candidate features, classifiers, sequential inference, scores and badness cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def boundary_features(docs: DataFrame, window: int = 4) -> DataFrame:
    """A row for each blank candidate: codes and classes of the characters beside it, its own code, the distance to the last boundary, the label.

    A candidate is a space character (not a plain blank between letters) at least window + 2 from either
    end; its label is whether it ends a line, our segment boundary, and its own code is then that of a blank.
    """
    table, names = char_classes(docs.sparkSession), [f"{x}{d}".replace("-", "m") for k in range(1, window + 1) for d in (-k, k) for x in ("code", "class")]
    apart = np.array([d for k in range(1, window + 1) for d in (-k, k)])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                yield of_texts(batch.slice(k, SLICE_ROWS))

    def of_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        # All texts one after the other, in code points.
        texts = [t or "" for t in batch.column("text").to_pylist()]
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size) - size
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        at = np.flatnonzero((codes == 32) | (codes >= 9) & (codes <= 13))
        of = np.searchsorted(start, at, "right") - 1
        i = at - start[of]
        far = (i >= window + 2) & (i < size[of] - window - 2)
        at, of, i = at[far], of[far], i[far]
        letter = table[codes] >= LETTER
        stay = ~((codes[at] == 32) & letter[at - 1] & letter[at + 1])
        at, of, i = at[stay], of[stay], i[stay]
        label = (codes[at] == 10).astype(np.int32)
        # The boundary before each candidate, if it is of the same text.
        held = np.concatenate(([-1], np.maximum.accumulate(np.where(label == 1, np.arange(len(at)), -1))))[:-1] if len(at) else np.zeros(0, np.int64)
        last = np.where((held >= 0) & (of[held] == of), i[held], -1) if len(at) else held
        beside = codes[at[:, None] + apart]
        sides = np.stack([beside, table[beside] % LETTER], axis=2).reshape(len(at), len(names)).astype(np.int32)
        arrays = [batch.column("doc_id").take(pa.array(of)), pa.array(i.astype(np.int32)), *[pa.array(c) for c in sides.T], pa.array(np.where(label == 1, 32, codes[at]).astype(np.int32)), pa.array((i - last - label).astype(np.int32)), pa.array(label)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "i", *names, "space", "distance", "label"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, i int, {', '.join(f'{n} int' for n in names)}, space int, distance int, label int")


#: Texts whose characters are held at once, and what is added to the class of a letter.
SLICE_ROWS, LETTER = 500, 16
_CLASSES: list[np.ndarray] = []


def char_classes(spark: SparkSession) -> np.ndarray:
    """Of every code point `category`, with LETTER added for letters, as the JVM knows them."""
    if not _CLASSES:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        known = spark.range(0, 0x110000, 1, 16).filter("id < 55296 or id > 57343").select("id", (T.category(char) + F.when(char.rlike(r"^\p{L}"), LETTER).otherwise(0)).cast("byte").alias("class")).toArrow()
        out = np.full(0x110000, 14, np.int8)
        out[known["id"].to_numpy()] = known["class"].to_numpy()
        _CLASSES.append(out)
    return _CLASSES[0]


def train(features: DataFrame, kind: str = "rf", weight: float = 1.0, seed: int = 1):
    """(assembler, models with their votes): "rf", "gbt", or "ada" (SAMME over weighted trees); `weight` is that of label 1."""
    inputs = [c for c in features.columns if c not in ("doc_id", "i", "label")]
    assembler = VectorAssembler(inputCols=inputs, outputCol="x")
    data = assembler.transform(features).withColumn("w", F.when(F.col("label") == 1, weight).otherwise(1.0))
    if kind == "rf":
        return assembler, [(RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", seed=seed, numTrees=20).fit(data), 1.0)]
    if kind == "gbt":
        return assembler, [(GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", seed=seed, maxIter=10).fit(data), 1.0)]
    models = []
    for _ in range(10):
        model = DecisionTreeClassifier(featuresCol="x", labelCol="label", weightCol="w", maxDepth=2, seed=seed).fit(data)
        wrong = model.transform(data).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double")).drop("rawPrediction", "probability", "prediction")
        sums = wrong.agg((F.sum(F.col("w") * F.col("miss")) / F.sum("w")).alias("e")).first()
        error = min(max(sums["e"], 1e-9), 1 - 1e-9)
        vote = float(__import__("math").log((1 - error) / error))
        if vote <= 0:
            break
        models.append((model, vote))
        data = wrong.withColumn("w", F.col("w") * F.exp(F.lit(vote) * F.col("miss"))).drop("miss")
    return assembler, models


def predict(features: DataFrame, trained) -> DataFrame:
    """`features` with `prediction` by weighted vote."""
    assembler, models = trained
    data = assembler.transform(features).withColumn("votes", F.lit(0.0))
    for model, vote in models:
        data = model.transform(data).withColumn("votes", F.col("votes") + F.lit(vote) * (2 * F.col("prediction") - 1)).drop("rawPrediction", "probability", "prediction")
    return data.withColumn("prediction", (F.col("votes") > 0).cast("int")).drop("x", "votes")


def scores(predicted: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    n = lambda p, y: F.count_if((F.col("prediction") == p) & (F.col("label") == y))
    s = predicted.agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))
    tp = F.col("tp").cast("double")
    return s.withColumns({"precision": F.try_divide(tp, F.col("tp") + F.col("fp")), "recall": F.try_divide(tp, F.col("tp") + F.col("fn")), "f1": F.try_divide(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def leave_one_out(features: DataFrame, kind: str = "rf", weight: float = 1.0, most: int = 30) -> DataFrame:
    """Predictions for each of up to `most` documents by a model of the others."""
    ids = [r["doc_id"] for r in features.select("doc_id").distinct().orderBy("doc_id").limit(most).collect()]
    out = None
    for d in ids:
        one = predict(features.filter(F.col("doc_id") == d), train(features.filter(F.col("doc_id").isin(ids) & (F.col("doc_id") != d)), kind, weight))
        out = one if out is None else out.unionByName(one)
    return out


def insert_boundaries(docs: DataFrame, decide, window: int = 4) -> DataFrame:
    """(doc_id, text) with \\n for the blanks that `decide` takes: decide(list of features) -> bool, the last feature the distance to the last boundary taken.

    Each decision depends on the ones before it, so that a document is one sequence.
    """
    rows = boundary_features(docs, window).drop("label")
    names = [c for c in rows.columns if c not in ("doc_id", "i", "distance")]
    both = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", *names))).alias("f")).join(docs.select("doc_id", "text"), "doc_id", "right")

    def run(batches):
        for pdf in batches:
            texts = []
            for text, found in zip(pdf["text"], pdf["f"], strict=True):
                chars, last = list(text or ""), -1
                for f in found if found is not None else []:
                    if decide([*[f[n] for n in names], f["i"] - last]):
                        chars[f["i"]], last = "\n", f["i"]
                texts.append("".join(chars))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return both.select("doc_id", "text", "f").mapInPandas(run, "doc_id long, text string")


def badness(cases: DataFrame) -> DataFrame:
    """One row over cases (case_id, s: scores of the true pair, neighbour, same and other document): means, and mean inversions; cases with NaN go."""
    whole = cases.filter(~F.exists("s", lambda x: F.isnan(x) | x.isNull()))
    return whole.agg(F.count("*").alias("n"), *[F.round(F.avg(F.get("s", F.lit(k))), 6).alias(f"mean{k}") for k in range(4)], F.round(F.avg(V.inversions(F.col("s"))), 6).alias("badness"))


def importances(trained) -> list[tuple[str, float]]:
    assembler, models = trained
    return sorted(zip(assembler.getInputCols(), models[0][0].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def probability(features: DataFrame, trained) -> DataFrame:
    """`features` with the first model's probability of a boundary."""
    assembler, models = trained
    return models[0][0].transform(assembler.transform(features)).withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
