"""What the operators share: storage between steps, and text as NumPy arrays.

Texts reach Python as Arrow batches and are handled as one byte buffer with offsets, in slices of
half a megabyte, so that memory is bounded by the longest text and no loop runs per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Rows of a few longs, of a stored table, that are sent to every task. Larger tables are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`, or a local one on a local master where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexweave-")
        sc.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager:
    """At most so many rows in an Arrow batch of what is planned and run inside."""
    return _settings(spark, {_BATCH: str(rows)})


def store(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: lineage ends here and no step runs twice.

    Shuffle files of the write go when it ends. batch_rows: at most so many rows in an Arrow batch, for rows of several texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})):
        # The plan, and with it the settings, are made anew.
        df.select("*").write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def at_hand(df: DataFrame) -> DataFrame:
    """A stored table of a few longs a row, marked to be sent to every task if it has BROADCAST_ROWS rows at most, else to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _release() -> None:
    """Return freed memory to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` that returns a task's memory when the task ends."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(own, schema)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of about `most` bytes of text, with their bytes and offsets. A longer text stands alone."""
    for batch in batches:
        data, at = as_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of _MUL and its inverse. Those of one slice are kept; a longer text makes its own."""
    if n <= SLICE_BYTES + 1 and _POWERS:
        return [p[:n] for p in _POWERS]
    made = []
    for base in (_MUL, _INV):
        grown = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        grown[0] = 1
        made.append(np.multiply.accumulate(grown, out=grown))
    if n <= SLICE_BYTES + 1:
        _POWERS[:] = made
    return [p[:n] for p in made]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of byte spans, for each of several ends: a polynomial over random values of the bytes, from prefix sums."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return [mix((sums[e] - sums[starts]) * down[starts] + (e - starts).astype(np.uint64)) for e in ends]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(data, starts, ends)[0]


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators, and `first`: row i has words first[i]:first[i+1]."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = at[1:][at[1:] > 0]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of one row, and the index of each window's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * _MUL + hashes[j : n + j]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(total[begins]), begins


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges starts[i] : starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)


def list_column(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values[first[i] : first[i + 1]] as binaries."""
    at = (first * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What packed has taken."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(held[at[0] : at[-1]].tobytes(), kind), (at - at[0]) // np.dtype(kind).itemsize


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
