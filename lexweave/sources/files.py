"""Sources and sinks. Inputs are never changed: a cleaned corpus is a new table."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, or a local one on a local master where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexweave-")
        sc.setCheckpointDir(found)
    return found


def store(df: DataFrame, name: str) -> DataFrame:
    """Write and read again, to end the lineage."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_whole_texts(spark: SparkSession, path: str, name_pattern: str = r"[0-9].xml$") -> DataFrame:
    """One row a file whose name matches: file_name, lang and year (from lang=/year= folders where there are), text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=False).withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    return files.withColumnRenamed("value", "text").filter(F.col("file_name").rlike(name_pattern))


def write_texts(df: DataFrame, path: str, by: tuple[str, ...] = ("lang", "year")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_segmented(df: DataFrame, boundary: str = "¤") -> DataFrame:
    """Rows (doc_id, lang, seg_no from 1, text) of texts whose segments `boundary` ends; trailing empty ones stay."""
    return df.select("doc_id", "lang", F.posexplode(F.split("text", boundary, -1)).alias("p", "segment")).select("doc_id", "lang", (F.col("p") + 1).alias("seg_no"), F.col("segment").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, file_name) of a JSON array of names."""
    names = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("names"))
    return names.select(F.posexplode("names").alias("pos", "file_name"))


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def save_vocabulary(vocab: DataFrame, path: str, meta: dict) -> None:
    """Words (tok, n, more) and a meta row with the number of types and tokens."""
    vocab.write.mode("overwrite").parquet(f"{path}/words")
    size = vocab.sparkSession.read.parquet(f"{path}/words").agg(F.count("tok").alias("types"), F.sum("n").alias("tokens")).first()
    _write_meta(vocab.sparkSession, path, meta | {"types": size["types"], "tokens": size["tokens"] or 0})


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Raises ValueError if there are not as many words, or counts, as the meta row says."""
    meta, vocab = _read_meta(spark, path), spark.read.parquet(f"{path}/words")
    size = vocab.agg(F.count("tok").alias("words"), F.count("n").alias("counts"), F.sum("n").alias("tokens")).first()
    if (size["words"], size["counts"], size["tokens"] or 0) != (meta["types"], meta["types"], meta["tokens"]):
        raise ValueError(f"vocabulary at {path} is damaged: {size.asDict()} for {meta}")
    return vocab, meta


def save_corpus(encoded: DataFrame, path: str, meta: dict, min_count: int) -> None:
    """Documents as ids (doc_id, ids, more), and a meta row with the count threshold of their model."""
    encoded.write.mode("overwrite").parquet(f"{path}/docs")
    total = encoded.sparkSession.read.parquet(f"{path}/docs").agg(F.sum(F.size(F.coalesce("ids", F.array())))).first()[0]
    _write_meta(encoded.sparkSession, path, meta | {"min_count": min_count, "tokens": total or 0})


def load_corpus(spark: SparkSession, path: str, min_count: int) -> tuple[DataFrame, dict]:
    """Raises ValueError if the corpus was encoded for a model of another count threshold."""
    meta = _read_meta(spark, path)
    if meta["min_count"] != min_count:
        raise ValueError(f"corpus at {path} was encoded at a threshold of {meta['min_count']}, not {min_count}")
    return spark.read.parquet(f"{path}/docs"), meta


def save_bisegments(links: DataFrame, path: str, meta: dict) -> None:
    """Ranges only, as Parquet, with a JSON row of languages and files beside them."""
    links.write.mode("overwrite").parquet(f"{path}/ranges")
    _write_meta(links.sparkSession, path, meta)


def load_bisegments(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Ranges and meta row; `bitext.with_texts` joins the segments' texts back."""
    return spark.read.parquet(f"{path}/ranges"), _read_meta(spark, path)


def save_model(vectors: DataFrame, path: str, meta: dict) -> None:
    """Vectors (space, wid, v) and their meta row: identifier, min_count, rows, dimension."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    vectors.write.mode("overwrite").parquet(f"{path}/vec")
    _write_meta(vectors.sparkSession, path, meta | {"rows": size["n"], "dim": size["d"]})


def load_model(spark: SparkSession, path: str, **expected) -> tuple[DataFrame, dict]:
    """Raises ValueError if the shape, or an expected meta value such as min_count, is not what the meta row says."""
    meta = _read_meta(spark, path)
    vectors = spark.read.parquet(f"{path}/vec")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    wrong = {k: (meta.get(k), v) for k, v in (expected | {"rows": size["n"], "dim": size["d"]}).items() if meta.get(k) != v}
    if wrong:
        raise ValueError(f"model at {path} has other values: {wrong}")
    return vectors, meta


def write_projector(vectors: DataFrame, labels: DataFrame, path: str, name: str) -> None:
    """Tab-separated vectors and labels by wid, and the projector's config with the tensor's shape."""
    both = vectors.join(labels, "wid").orderBy("wid")
    both.select(F.array_join(F.transform("v", lambda x: x.cast("string")), "\t").alias("value")).write.mode("overwrite").text(f"{path}/tensor")
    both.select(F.col("word").alias("value")).write.mode("overwrite").text(f"{path}/metadata")
    size = both.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    config = {"embeddings": [{"tensorName": name, "tensorShape": [size["n"], size["d"]], "tensorPath": "tensor", "metadataPath": "metadata"}]}
    vectors.sparkSession.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
