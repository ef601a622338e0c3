"""Token counts over files as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import shared_dir


def token_counts(docs: DataFrame) -> DataFrame:
    """(lang, tok, n) of a stream of documents (lang, text): the state is one count a type."""
    return docs.select("lang", F.explode(T.tokens(F.lower("text"))).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("n"))


def run_available(spark: SparkSession, path: str, schema: str, files_each: int = 64) -> DataFrame:
    """The counts after all Parquet files at `path`, a folder or a glob, have been taken in, in batches of `files_each`.

    Each batch writes only the types that it changed, with their new counts, to its own folder; the
    latest count of a type, which never falls, is its greatest. A batch that runs again overwrites its folder.
    """
    home = f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{home}/changes/batch={batch}")

    put_all = token_counts(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{home}/state")
    put_all.trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema("lang string, tok string, n long, batch long").parquet(f"{home}/changes")
    return changes.groupBy("lang", "tok").agg(F.max("n").alias("n"))
