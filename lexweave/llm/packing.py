"""Best-fit packing of tokenised documents into sequences of bounded length.

The configuration linear program over the length histogram (at most `capacity` lengths, whatever the
number of documents) is solved by multiplicative weights: a configuration is a set of lengths that fits
a sequence; each step prices the lengths, finds the dearest configuration by a knapsack dynamic program,
takes a share of it that what is left allows, as whole sequences, and lowers the prices of what it holds: the
solution is rounded as it grows. What is left is packed by best fit over the histogram, longest first. Where best fit alone takes fewer sequences, its packing is taken. The prices give
a lower bound for all packings, `Plan.bound`. The result is a plan of a few thousand rows. Ranks of equal lengths, from
counts by task and a running sum over tasks, then give every piece its sequence and offset.

A null text is an empty one and still has its end id. Repeated rows are packed each. Ties between
equal lengths are broken by task and row, and any assignment among equal lengths packs as well. No
documents give no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, list_column, mapped, ragged, read, slices, span_hash, store

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Steps of multiplicative weights for each distinct length, how fast prices fall, the share of what is left that a
#: step takes, and how much more a long length is worth than short ones that make it up.
STEPS, FALL, TAKE, LONG_FIRST = 2, 1.0, 0.5, 1.05
#: Chunks whose ids a task remembers before it starts anew.
REMEMBER = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER = np.arange(256) < 0x80
_OTHER &= ~_LETTER & ~SPACE

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


class Chunks:
    """Ids of texts by the ids of their chunks.

    A chunk begins at white space that follows something else, and at any other character below 0x80 that is no letter and follows a
    letter A-Z or a-z. The tokenizer's words never run across either, so that chunks have the same ids alone as in the
    text; each distinct one goes to the tokenizer once. Special tokens may run across the second: texts
    beside one are cut at white space alone. Where one has white space, or takes white space beside it, each
    text is one chunk.
    """

    def __init__(self, path: str, special: bool = True):
        """special: whether special tokens in texts have their ids, as in the plain call; else they are spelled, and chunks are cut at white space alone."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = list(self.tokenizer.get_added_tokens_decoder().values()) if special else []
        self.whole = any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added)
        self.fine, self.special = special, [t.content.encode() for t in added]
        marks = [t.content for t in added if t.special and not (t.single_word or t.normalized or self.whole)]
        self.mark = (marks[0], self.tokenizer.token_to_id(marks[0])) if marks else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if self.mark and not any(self.mark[0] in t for t in texts):
            # One call for all: a special token cuts the text, and its id the ids.
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark[1]), len(ids))
            return ids[ids != self.mark[1]], np.diff(ends, prepend=-1) - 1
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum())), count

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and the offsets of the texts."""
        flat, length, first = self.by_chunk(data, at)
        offsets = np.concatenate(([0], np.cumsum(length)))[first] + np.arange(len(at))
        out = np.full(offsets[-1], END_ID, np.uint32)
        where = np.ones(len(out), bool)
        where[offsets[1:] - 1] = False
        out[where] = flat
        return out, offsets

    def by_chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, how many each has, and the texts' first chunks."""
        space, raw = SPACE[data], data.tobytes()
        opens = np.zeros(len(data), bool)
        if not self.whole:
            opens[1:] = space[1:] & ~space[:-1]
            if self.fine and not any(t in raw for t in self.special):
                opens[1:] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
        opens[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys = span_hash(data, starts, ends)
        own, one, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBER:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            got, count = self._ids([raw[starts[i] : ends[i]].decode() for i in one[new]])
            begin = len(self.ids) + np.concatenate(([0], np.cumsum(count)[:-1]))
            self.ids = np.concatenate([self.ids, got])
            keys = np.concatenate([self.keys, own[new]])
            order = np.argsort(keys, kind="stable")  # two runs that are in order
            self.keys, self.begin, self.count = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]
            place = np.searchsorted(self.keys, own)
        place = place[which]
        length = self.count[place]
        flat = self.ids[ragged(self.begin[place], length)]
        return flat, length, np.searchsorted(starts, at)


def cut(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of texts of such lengths: the text, start and length of each. Only a first piece is short."""
    pieces = -(-length // capacity)
    text = np.repeat(np.arange(len(length)), pieces)
    number = ragged(np.zeros(len(length), np.int64), pieces)
    head = length - (pieces - 1) * capacity
    start = np.where(number == 0, 0, head[text] + (number - 1) * capacity)
    return text, start, np.where(number == 0, head[text], capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows of _PIECE (and `ids`) for docs (doc_id long, text string). rank: among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, seen = Chunks(tokenizer), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch, data, at in slices(batches):
            ids, offsets = chunks.encode(data, at)
            text, start, length = cut(np.diff(offsets), capacity)
            begin = offsets[text] + start
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin, begin + length, strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, counts = np.unique(length, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = ragged(seen[sizes], counts)
            seen[sizes] += counts
            number = ragged(np.zeros(batch.num_rows, np.int64), np.bincount(text, minlength=batch.num_rows))
            arrays = [batch.column("doc_id").take(pa.array(text)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(text), task), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                arrays.append(list_column(ids.astype(np.int32), np.append(begin, len(ids)), pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return mapped(docs, run, _PIECE + (", ids array<int>" if with_ids else ""))


def dearest(price: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The set of lengths, each any number of times, of highest price within `capacity`: knapsack by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        value = best[c - lengths[: usable[c]]] + price[: usable[c]]
        k = len(value) - 1 - int(value[::-1].argmax())  # of equals the longest: short ones fit anywhere later
        if value[k] > best[c - 1]:
            best[c], taken[c] = value[k], k
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[int(taken[c])] = out.get(int(taken[c]), 0) + 1
            c -= int(lengths[taken[c]])
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(index of length -> how many, number of sequences) from the linear program, rounded, within what exists; and a lower bound.

    The bound is the best of the steps' dual solutions: prices over the dearest configuration's price.
    """
    weight, left, out, bound = np.ones(len(lengths)), counts.copy(), {}, 0.0
    for _ in range(STEPS * len(lengths)):
        own = np.flatnonzero(left)
        if not len(own):
            break
        price = lengths[own] ** LONG_FIRST * weight[own]
        config = dearest(price, lengths[own], capacity)
        k, n = np.array(list(config)), np.array(list(config.values()))
        if len(own) == len(lengths):
            bound = max(bound, float(counts @ price) / float(n @ price[k]))
        ids = own[k]
        # A share of what is left, as a whole number of sequences: the solution is rounded as it grows.
        n = np.minimum(n, left[ids])
        times = max(1, int((left[ids] // n).min() * TAKE))
        left[ids] -= n * times
        weight[ids] *= np.exp(-FALL * times * n / counts[ids])
        weight /= weight.max()
        key = tuple(sorted(zip(ids.tolist(), n.tolist(), strict=True)))
        out[key] = out.get(key, 0) + times
    return [(dict(key), times) for key, times in out.items()], bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over groups of sequences with the same content."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room left
    for i in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[i]), int(counts[i])
        while left:
            room = min((r for r in groups if r >= size), default=None)
            if room is None:
                each = capacity // size
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        groups.setdefault(capacity - n * size, []).append(({i: n}, times))
                break
            config, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
            n = min(room // size, max(1, left // times))
            take = min(times, left // n)
            if take < times:
                groups.setdefault(room, []).append((config, times - take))
            groups.setdefault(room - n * size, []).append((config | {i: config.get(i, 0) + n}, take))
            left -= n * take
    return [g for gs in groups.values() for g in gs]


class Plan:
    """Sequence and offset of the k-th piece of each length.

    bound: no packing has fewer sequences. solved: how many pieces the linear program places.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        lengths = np.array(sorted(histogram), np.int64)
        counts = np.array([histogram[int(x)] for x in lengths], np.int64)
        short = lengths < capacity
        groups = [({len(lengths) - 1: 1}, int(counts[-1]))] if len(lengths) and not short[-1] else []
        self.bound, self.solved = sum(n for _, n in groups), 0
        if short.any():
            solved, bound = configurations(lengths[short], counts[short], capacity)
            self.bound += max(int(np.ceil(bound - 1e-6)), -(-int(lengths[short] @ counts[short]) // capacity))
            left = counts[short].copy()
            for config, times in solved:
                for i, n in config.items():
                    left[i] -= n * times
            kept = np.flatnonzero(left)
            mixed = solved + [({int(kept[i]): n for i, n in config.items()}, times) for config, times in best_fit(lengths[short][kept], left[kept], capacity)]
            plain = best_fit(lengths[short], counts[short], capacity)
            better = sum(n for _, n in mixed) <= sum(n for _, n in plain)
            groups += mixed if better else plain
            self.solved = int((counts[short] - left).sum()) if better else 0
        slots: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        filled, base = np.zeros(capacity + 1, np.int64), 0
        for config, times in groups:
            offset = 0
            for i, n in sorted(config.items(), reverse=True):
                size = int(lengths[i])
                slots[size].append((int(filled[size]), base, n, offset))
                filled[size] += n * times
                offset += n * size
            base += times
        self.sequences = base
        self.slots = [np.array(s, np.int64).reshape(-1, 4) for s in slots]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            first, base, n, at = self.slots[size].T
            k = np.searchsorted(first, rank[own], "right") - 1
            j = rank[own] - first[k]
            sequence[own], offset[own] = base[k] + j // n[k], at[k] + j % n[k] * size
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset (and `ids`) for docs (doc_id long, text string)."""
    cut_up = store(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    by_task = store(cut_up.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # One row a length: at most `capacity`.
    plan = Plan({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut_up.join(by_task.select("length", "task", before.alias("before")), ["length", "task"]).select(*[c for c in cut_up.columns if c not in ("task", "rank")], (F.col("before") + F.col("rank")).alias("rank"))
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return mapped(ranked, run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with `ids`: at most one sequence's ids meet in a group."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return each.select("sequence_id", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), tokenizer_path())
