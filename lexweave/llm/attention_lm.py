"""LM scoring by a causal self-attention model trained in NumPy on subword ids.

Words are `[^\\x20\\x09-\\x0D]+` of the text, A-Z in lower case; each is followed by the next, and the last by
an end. A word's subwords are those of a public tokenizer for a blank and the word. One layer of masked attention
over the subwords before (each has a vector of its own, besides its class's) gives the class of the next one
by a softmax, and the subword within its class by a hierarchical one: a Huffman tree over the class, each turn of
which has weights over what attention gives, and starts from the frequencies. A class holds beginnings of words alone, or none.
Texts are cut into windows of WINDOW subwords that overlap
by WINDOW - STRIDE, so that each subword is scored once, with that many before it at least (but for the
start).

A word's probability in the attention model is that of its subwords, given that a word begins, and that
the next subword begins a word (or is the end): over all words these add to no more than 1. The score
mixes it, at weight 1 - COUNTS, with the word's share of all training words, at weight COUNTS. Unknown words have the
former alone. Without training words nothing has a share, and the model is as it was at the start.

Corpus counts, subword counts, classes and the attention weights cover all training documents. The weights
are trained in EPOCHS passes: every task goes once over its own documents from the same weights, and the
tasks' weights are averaged by their subwords, those of one subword or turn by how often a task met it. Null and empty texts have an end alone. Null ids are not
held out. Repeated rows are scored alike, and count as often as they occur. Empty tables give no rows.
Only doc_id and text of the input are used.

Texts are read and tokenised once, in chunks: a chunk is some megabytes of texts of one task with its distinct words, each
of which is spelled once. Its texts are kept as subword ids alone, for training and scoring: no two words have the same
subwords, so that a hash of them names the word. Counts
reach them by chunks, so that a word travels once a chunk and no count table is broadcast. Texts and counts of
a chunk meet in one task, and each moves once.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, discard, mapped, packed, ragged, read, signed, slices, span_hash, store, unpacked, words
from .packing import Chunks

FOLDS, HELD = 7, 2
TOKENIZER = "byte_bpe_50k.json"
END, VOCABULARY = 50256, 50257
CHUNK_BYTES = 1 << 22
#: Subwords of texts that are windowed at once.
PART = 1 << 17
DIM, CLASSES, WINDOW, STRIDE = 8, 32, 16, 12
EPOCHS, BATCH, RATE = 1, 128, 0.02
#: Weight of a word's share of the training words.
COUNTS = 0.5
#: Subwords are clustered by how often the commonest ones stand right before and after them.
COMMON = 16
#: Rate of the vectors of subwords and turns.
ROW_RATE = 0.1


def spelled(data: np.ndarray, at: np.ndarray, chunks: Chunks) -> tuple[np.ndarray, ...]:
    """For lower-case bytes: word hashes of all texts; the words' first by text, ends counted; subword ids of all, ends too; the first subword of each."""
    own, which, first, ids, begin = distinct(data, at, chunks)
    flat, offsets = laid_out(which, first, ids, begin)
    return own[which], first + np.arange(len(at)), flat, np.append(np.flatnonzero(_opens(which, first, np.diff(begin))), offsets[-1])


def distinct(data: np.ndarray, at: np.ndarray, chunks: Chunks) -> tuple[np.ndarray, ...]:
    """For lower-case bytes: hashes of the distinct words; which of them each word is; the words' first by text; the distinct words' subword ids, and the first of each."""
    starts, ends, first = words(data, at, SPACE)
    own, one, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    starts, length = starts[one], ends[one] - starts[one]
    # A blank and the word, one after the other: the tokenizer's chunks are the words.
    plain = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    plain[ragged(np.concatenate(([0], np.cumsum(length + 1)))[:-1] + 1, length)] = data[ragged(starts, length)]
    ids, count, _ = chunks.by_chunk(plain, np.array([0, len(plain)]))
    return own, which, first, ids, np.concatenate(([0], np.cumsum(count)))


def laid_out(which: np.ndarray, first: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all texts, each followed by END, and the offsets of the texts. ids, begin: of the distinct words."""
    count = np.diff(begin)[which]
    offsets = np.concatenate(([0], np.cumsum(count)))[first] + np.arange(len(first))
    flat = np.full(offsets[-1], END, np.uint16)
    spot = np.ones(len(flat), bool)
    spot[offsets[1:] - 1] = False
    flat[spot] = ids[ragged(begin[which], count)]
    return flat, offsets


def _opens(which: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which subwords of all texts, ends too, are the first of a word or an end."""
    place = first + np.arange(len(first))
    whole = np.ones(place[-1], np.int64)
    is_word = np.ones(place[-1], bool)
    is_word[place[1:] - 1] = False
    whole[is_word] = count[which]
    out = np.zeros(int(whole.sum()), bool)
    out[np.cumsum(whole) - whole] = True
    return out


def word_starts(tokenizer: str) -> np.ndarray:
    """Which subwords begin a word, or are the end."""
    from tokenizers import Tokenizer

    out = np.zeros(VOCABULARY, bool)
    for token, i in Tokenizer.from_file(tokenizer).get_vocab().items():
        out[i] = token.startswith("\u0120")
    out[END] = True
    return out


class Attention:
    """Class of the next subword from the classes before it."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"embed": init(CLASSES + 1, DIM), "place": init(WINDOW, DIM), "q": init(DIM, DIM), "k": init(DIM, DIM), "v": init(DIM, DIM), "out": init(2 * DIM, CLASSES), "bias": np.zeros(CLASSES, np.float32)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.classes = np.zeros(VOCABULARY, np.int64)
        self.inner = np.full(VOCABULARY, -np.log(VOCABULARY), np.float32)
        self.starting = np.zeros(CLASSES, np.float32)
        # Vectors of the subwords before (VOCABULARY: none), and of the turns in the classes' trees.
        self.rows = {"before": np.zeros((VOCABULARY + 1, DIM), np.float32), "turns": np.zeros((VOCABULARY, 2 * DIM), np.float32)}
        # The turns to each subword: its first, then of each the number, the side (1, -1), and what it is worth without context.
        self.path, self.turn, self.side, self.alone = np.zeros(VOCABULARY + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32)

    def forward(self, x: np.ndarray, keep: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        """x: windows of class ids (CLASSES: none before), of the subwords `ids`, if given. Log probabilities of the next class at every place, or at the flat places `keep` alone."""
        z, state = self.logits(x, keep, ids)
        z -= np.log(np.exp(z).sum(-1, keepdims=True))
        return z, state

    def logits(self, x: np.ndarray, keep: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        """As forward, before they are made to add to one; the largest of a place is 0."""
        p, n = self.p, len(x)
        # Rows of all windows in one product each: a product a window costs more in calls than in sums.
        e = p["embed"].take(x, 0) + p["place"]
        if ids is not None:
            e += self.rows["before"].take(ids, 0)
        e = e.reshape(-1, DIM)
        q, k, v = ((e @ p[c]).reshape(n, WINDOW, DIM) for c in "qkv")
        q *= np.float32(1 / np.sqrt(DIM))
        a = q @ k.transpose(0, 2, 1)
        a += self.mask
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        h = np.empty((n * WINDOW, 2 * DIM), np.float32)
        h[:, :DIM], h[:, DIM:] = (a @ v).reshape(-1, DIM), e
        kept = h if keep is None else h.take(keep, 0)
        z = kept @ p["out"]
        z += p["bias"]
        z -= z.max(-1, keepdims=True)
        return (z.reshape(n, WINDOW, -1) if keep is None else z), {"x": x, "e": e, "q": q, "k": k, "v": v, "a": a, "h": h, "keep": keep, "kept": kept}

    def backward(self, z: np.ndarray, s: dict, y: np.ndarray, weight: np.ndarray, more: np.ndarray | None = None) -> dict:
        """Gradients of the mean loss by weight. y, weight: as z, which forward gave with the state s, where those of its inputs are left. more: what else depends on s["kept"]."""
        p, keep, n = self.p, s["keep"], len(s["x"])
        dz, y, weight = np.exp(z).reshape(-1, z.shape[-1]), y.ravel(), weight.ravel()
        dz[np.arange(len(y)), y] -= 1
        dz *= (weight / max(1.0, weight.sum()))[:, None]
        g = {"out": s["kept"].T @ dz, "bias": dz.sum(0)}
        dh = dz @ p["out"].T
        if more is not None:
            dh += more
        if keep is not None:
            whole = np.zeros_like(s["h"])
            whole[keep] = dh
            dh = whole
        mixed, de = dh[:, :DIM].reshape(n, WINDOW, DIM), dh[:, DIM:].copy()
        da, dv = mixed @ s["v"].transpose(0, 2, 1), s["a"].transpose(0, 2, 1) @ mixed
        da -= (da * s["a"]).sum(-1, keepdims=True)
        da *= s["a"]
        # q is held divided by the root of DIM.
        dq, dk = da @ s["k"] * np.float32(1 / np.sqrt(DIM)), da.transpose(0, 2, 1) @ s["q"]
        for name, d in (("q", dq), ("k", dk), ("v", dv)):
            d = d.reshape(-1, DIM)
            g[name] = s["e"].T @ d
            de += d @ p[name].T
        g["place"] = de.reshape(n, WINDOW, DIM).sum(0)
        g["embed"] = (s["x"].reshape(1, -1) == np.arange(CLASSES + 1)[:, None]).astype(np.float32) @ de
        s["inputs"] = de
        return g

    def turns(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in `turn` of all turns to the subwords, and how many each has."""
        count = self.path[ids + 1] - self.path[ids]
        return ragged(self.path[ids], count), count

    def within(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logs of the subwords' probabilities in their classes, less those without context, for rows of what attention gives."""
        at, count = self.turns(ids)
        u = np.einsum("ij,ij->i", np.repeat(h, count, 0), self.rows["turns"].take(self.turn[at], 0)) * self.side[at] + self.alone[at]
        return np.bincount(np.repeat(np.arange(len(ids)), count), _log_sigmoid(u) - _log_sigmoid(self.alone[at]), len(ids))

    def set_classes(self, count: np.ndarray, near: np.ndarray, starts: np.ndarray, seed: int = 5) -> None:
        """Classes and frequencies within them, from the subwords' counts and those of their neighbours. starts: which begin a word."""
        self.classes = _cluster(near, count, starts, np.random.default_rng(seed))
        smooth = count + 0.01
        self.starting = (np.bincount(self.classes, smooth * starts, CLASSES) / np.maximum(np.bincount(self.classes, smooth, CLASSES), 1e-12)).astype(np.float32)
        self.inner = np.log(smooth / np.bincount(self.classes, smooth, CLASSES)[self.classes]).astype(np.float32)
        self.path, self.turn, self.side, self.alone = _trees(self.classes, smooth)

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> tuple[int, dict]:
        """One pass over texts, batches of (ids, first): Adam, and Adagrad by rows of the vectors. Returns the number of subwords, and how often each row was met."""
        rng, total = np.random.default_rng(seed), 0
        mean, square, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        spent, met = ({k: np.full(len(v), start, np.float32) for k, v in self.rows.items()} for start in (1, 0))
        classes = np.append(self.classes, CLASSES)

        def descend(k: str, own: np.ndarray, grads: np.ndarray) -> None:
            order = np.argsort(own.astype(np.uint16), kind="stable")
            own = own[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            if len(first):
                group = np.empty(len(order), np.int64)
                group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
                sums, own = _row_sums(grads, group, len(first)), own[first]
                spent[k][own] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
                met[k][own] += np.diff(first, append=len(order))
                self.rows[k][own] -= ROW_RATE * sums / np.sqrt(spent[k][own])[:, None]

        for ids, first in batches:
            x, y, new, _ = windows_of_all(ids, first, VOCABULARY)
            total += len(ids)
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                before, keep = x[own], np.flatnonzero(new[own])
                z, state = self.forward(classes[before], keep, before)
                wanted, n = y[own].ravel()[keep], np.float32(max(1, len(keep)))
                at, count = self.turns(wanted)
                turn, h = self.turn[at], np.repeat(state["kept"], count, 0)
                vectors = self.rows["turns"].take(turn, 0)
                u = np.einsum("ij,ij->i", h, vectors) * self.side[at] + self.alone[at]
                off = (-self.side[at] / (1 + np.exp(np.minimum(u, 60))))[:, None]
                vectors *= off
                more = _row_sums(vectors, np.repeat(np.arange(len(wanted)), count), len(wanted))
                h *= off
                for k, g in self.backward(z, state, classes[wanted], np.ones(len(keep), np.float32), more / n).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                descend("turns", turn, h)
                descend("before", before.ravel(), state["inputs"] * n)
        return total, met

    def log_probabilities(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs for each subword of the texts ids[first[i]:first[i+1]], and of a word's beginning in its place."""
        out, begins = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        x, y, new, where = windows_of_all(ids, first, VOCABULARY)
        classes = np.append(self.classes, CLASSES)
        # One product gives the sum of all classes and that of a word's beginning.
        sums = np.stack([np.ones(CLASSES, np.float32), self.starting], 1)
        for a in range(0, len(x), BATCH):
            before, keep = x[a : a + BATCH], np.flatnonzero(new[a : a + BATCH])
            z, state = self.logits(classes[before], keep, before)
            wanted = y[a : a + BATCH].ravel()[keep]
            at = where[a : a + BATCH].ravel()[keep]
            got = z[np.arange(len(keep)), classes[wanted]]
            both = np.exp(z, out=z) @ sums
            logs = np.log(both[:, 0])
            out[at] = got - logs + self.within(state["kept"], wanted)
            begins[at] = np.log(both[:, 1] / both[:, 0] + 1e-30)
        return out + self.inner[ids], begins

    def word_log_probabilities(self, ids: np.ndarray, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Natural logs for each word and end. first: of the texts, in words; begin: of the words, in subwords."""
        own, begins = (x.astype(np.float64) for x in self.log_probabilities(ids, begin[first]))
        out = np.add.reduceat(own, begin[:-1]) - begins[begin[:-1]]
        more = np.ones(len(out), bool)
        more[first[1:] - 1] = False  # nothing follows an end
        out[more] += begins[begin[1:][more]]
        return out


def _row_sums(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n groups."""
    width = x.shape[1]
    at = (group[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, x.ravel(), n * width).reshape(n, width).astype(np.float32)


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.minimum(x, 0) - np.log1p(np.exp(-np.abs(x)))


def _trees(classes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """A Huffman tree for each class, as Attention has them: path, turn, side, alone."""
    n, turns = len(classes), 0
    above, side, odds = np.full(2 * n, -1), np.zeros(2 * n, np.float32), np.zeros(2 * n)
    order = np.argsort(classes, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(classes[order])) + 1):
        heap = list(zip(weight[own].tolist(), own.tolist(), strict=True))
        heapq.heapify(heap)
        while len(heap) > 1:
            (u, a), (v, b) = heapq.heappop(heap), heapq.heappop(heap)
            above[a] = above[b] = turns
            side[a], side[b], odds[a], odds[b] = 1, -1, np.log(u / v), np.log(v / u)
            heapq.heappush(heap, (u + v, n + turns))
            turns += 1
    at, leaf, found = np.arange(n), np.arange(n), []
    while len(at := at[(up := above[at] >= 0)]):
        leaf = leaf[up]
        found.append((leaf, above[at], side[at], odds[at]))
        at = n + above[at]
    if not found:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32)
    leaf, turn, sides, alone = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(leaf, kind="stable")
    return np.searchsorted(leaf[order], np.arange(n + 1)), turn[order].astype(np.int32), sides[order], alone[order].astype(np.float32)


def windows_of_all(classes: np.ndarray, first: np.ndarray, none: int = CLASSES) -> tuple[np.ndarray, ...]:
    """Windows over all texts: inputs (`none`: none before), targets, which targets this window scores, and where they are.

    Window j of a text covers the targets from j * STRIDE on; all but the first window score the last STRIDE only.
    """
    length = np.diff(first)
    number = np.maximum(1, 1 + -(-np.maximum(0, length - WINDOW) // STRIDE)) * (length > 0)
    text = np.repeat(np.arange(len(length)), number)
    start = ragged(np.zeros(len(length), np.int64), number) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    inside = place < length[text][:, None]
    where = np.minimum(first[text][:, None] + place, max(0, len(classes) - 1))
    y = classes[where]
    x = np.where(place == 0, none, classes[np.maximum(where - 1, 0)])
    new = inside & ((start == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return x, y, new, where


def windows_of(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return windows_of_all(classes, np.array([0, len(classes)]))[:3]


def neighbours(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each pair of neighbours of one text, the subword times 2 * COMMON and the place of the other one, if that is among the COMMON commonest."""
    common = np.argsort(-count, kind="stable")[:COMMON]
    column = np.full(VOCABULARY, -1)
    column[common] = np.arange(COMMON)
    last = np.zeros(max(1, len(ids)), bool)
    last[first[1:][first[1:] > 0] - 1] = True
    inside = np.flatnonzero(~last[: max(0, len(ids) - 1)])
    left, right = ids[inside], ids[inside + 1]
    after, before = column[right] >= 0, column[left] >= 0
    return np.concatenate([left[after] * 2 * COMMON + column[right[after]], right[before] * 2 * COMMON + COMMON + column[left[before]]])


def _cluster(near: np.ndarray, count: np.ndarray, starts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Classes of subwords with like neighbours, by k-means on their counts beside the commonest ones, apart for those that begin words.

    Of those not seen, the ones that begin words join the likeliest class of such, and the others share the last.
    """
    out, base = np.full(VOCABULARY, CLASSES - 1), 0
    share = np.sqrt(count[starts]).sum() / np.sqrt(count).sum()
    first = int(np.clip(round(share * (CLASSES - 1)), 1, CLASSES - 2))
    for own_starts, number in ((starts, first), (~starts, CLASSES - 1 - first)):
        seen = np.flatnonzero((count > 0) & own_starts)
        if len(seen):
            out[seen] = base + _means(near[seen], count[seen], number, rng)
        if not base:
            out[np.flatnonzero((count == 0) & starts)] = np.bincount(out[seen], count[seen], 1)[:number].argmax()
        base += number
    return out


def _means(near: np.ndarray, count: np.ndarray, number: int, rng: np.random.Generator) -> np.ndarray:
    x = np.sqrt((near + 0.02) / (near + 0.02).sum(1, keepdims=True))
    weight = np.sqrt(count)
    centre = x[rng.choice(len(x), number, replace=len(x) < number, p=weight / weight.sum())]
    for _ in range(12):
        which = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        for c in range(number):
            if (own := which == c).any():
                centre[c] = np.average(x[own], axis=0, weights=weight[own])
    return which


_CHUNKS = "chunk long, doc_id long, held_out boolean, ids binary, words array<bigint>, counts array<bigint>"


def word_hashes(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each word's subwords, ids[begin[i]:begin[i+1]]."""
    return span_hash(ids.astype("<u2").view(np.uint8), 2 * begin[:-1], 2 * begin[1:])


def prepared(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Chunks: a row for every text (chunk, doc_id, held_out, ids), and one with the word_hashes of the chunk's distinct words and their training counts.

    ids: the text's subwords and END, of 16 bits. A
    distinct word of a chunk is spelled once, and no text is tokenised a second time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, spelling = TaskContext.get().partitionId(), 0, Chunks(tokenizer, special=False)
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        longs = pa.list_(pa.int64())
        for batch, data, at in slices(batches, most=CHUNK_BYTES):
            chunk, k, n = (task << 32) + k, k + 1, batch.num_rows
            _, which, first, ids, begin = distinct(LOWER[data], at, spelling)
            flat, offsets = laid_out(which, first, ids, begin)
            learn = ~np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            counts = np.bincount(which[learn], minlength=len(begin) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), batch.column("doc_id"), batch.column("held_out"), packed(flat, offsets), pa.nulls(n, longs), pa.nulls(n, longs)], names)
            lists = [pa.array([x], longs) for x in (signed(word_hashes(ids, begin)), counts)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), *lists], names)

    return mapped(docs, run, _CHUNKS)


def parts(first: np.ndarray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about `most` subwords. A longer text stands alone."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, "right")) - 1)
        yield a, b
        a = b


def _tally(texts: DataFrame, keys: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """How often keys(ids, first) give each number under `size`, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for ids, first in id_batches(batches):
            sums += np.bincount(keys(ids, first), minlength=size)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"k": pa.array(own), "n": pa.array(sums[own])})

    got = mapped(texts, run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def id_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Subword ids of the texts of a batch, and their offsets."""
    for batch in batches:
        flat, first = unpacked(batch.column("ids"), np.uint16)
        for a, b in parts(first):
            yield flat[first[a] : first[b]].astype(np.int64), first[a : b + 1] - first[a]


def fit(docs: DataFrame, tokenizer: str) -> Attention:
    """docs: (doc_id, held_out, text)."""
    chunks = store(prepared(docs, tokenizer), "chunks")
    model = learned(chunks, tokenizer)
    discard(chunks)
    return model


def learned(chunks: DataFrame, tokenizer: str) -> Attention:
    """From the training texts of what `prepared` gives."""
    texts = chunks.filter("words is null and not held_out").select("ids")
    model, sc = Attention(), chunks.sparkSession.sparkContext
    count = _tally(texts, lambda ids, first: ids, VOCABULARY)
    if not count.any():
        return model
    near = _tally(texts, lambda ids, first: neighbours(ids, first, count), VOCABULARY * 2 * COMMON).reshape(-1, 2 * COMMON).astype(np.float32)
    model.set_classes(count, near, word_starts(tokenizer))
    for epoch in range(EPOCHS):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            own = copy.copy(shared.value)
            own.p, own.rows = ({k: v.copy() for k, v in x.items()} for x in (own.p, own.rows))
            total, met = own.learn(id_batches(batches), 5 + epoch)
            for k, n, x in _weights(own, total, met) if total else ():
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n, pa.float64()), *[pa.array(c, pa.float32()) for c in x.T]], ["k", "n", *held])

        held = [f"x{i}" for i in range(2 * DIM)]
        got = mapped(texts, run, "k int, n double, " + ", ".join(f"{c} float" for c in held)).groupBy("k").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in held]).toArrow()
        _take(model, got.column("k").to_numpy(), np.stack([got.column(c).to_numpy() for c in held], 1))
        shared.unpersist()
    return model


def _weights(model: Attention, total: int, met: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, weights and values of the rows of 2 * DIM that make up the model; vectors that were not met are left out."""
    flat = np.concatenate([v.ravel() for v in model.p.values()])
    flat = np.pad(flat, (0, -len(flat) % (2 * DIM))).reshape(-1, 2 * DIM)
    yield np.arange(len(flat)), np.full(len(flat), float(total)), flat
    base = len(flat)
    for k, v in model.rows.items():
        own = np.flatnonzero(met[k])
        yield base + own, met[k][own], np.pad(v[own], ((0, 0), (0, 2 * DIM - v.shape[1])))
        base += len(v)


def _take(model: Attention, k: np.ndarray, x: np.ndarray) -> None:
    """Rows of _weights into the model."""
    sizes = [v.size for v in model.p.values()]
    flat = np.zeros((-(-sum(sizes) // (2 * DIM)), 2 * DIM))
    flat[k[k < len(flat)]] = x[k < len(flat)]
    ends = np.cumsum(sizes)
    model.p = {c: flat.ravel()[e - v.size : e].reshape(v.shape).astype(np.float32) for (c, v), e in zip(model.p.items(), ends, strict=True)}
    base = len(flat)
    for v in model.rows.values():
        own = (k >= base) & (k < base + len(v))
        v[k[own] - base] = x[own, : v.shape[1]]
        base += len(v)


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id long, text string)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = store(prepared(docs, tokenizer), "chunks")
    model = learned(chunks, tokenizer)
    opens = word_starts(tokenizer)
    tables = chunks.filter("words is not null")
    pairs = tables.select("chunk", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("chunk", F.col("w.words").alias("h"), F.col("w.counts").alias("n"))
    counts = store(pairs.filter("n > 0").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    ends = chunks.filter("words is null and not held_out").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct_ = sums["n"] + ends, sums["v"] + (ends > 0)
    # Of a chunk each word goes once: the hottest word has one row a chunk.
    known = pairs.select(F.col("chunk").alias("at"), "h").join(counts, "h").select("at", "h", "c")
    shared = docs.sparkSession.sparkContext.broadcast((model, opens))

    def run(key: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
        own_model, opens_ = shared.value
        out, order = [], np.argsort(asked.column("h").to_numpy())
        # One more, that nothing has.
        hashes, counted = asked.column("h").to_numpy()[order], np.append(asked.column("c").to_numpy()[order], 0)
        for batch in texts.combine_chunks().to_batches():
            flat, first_id = unpacked(batch.column("ids"), np.uint16)
            for a, b in parts(first_id):
                ids = flat[first_id[a] : first_id[b]].astype(np.int64)
                begin = np.append(np.flatnonzero(opens_[ids]), len(ids))
                first = np.searchsorted(begin, first_id[a : b + 1] - first_id[a])  # an end for each text
                asks, of = np.unique(signed(word_hashes(ids, begin)), return_inverse=True)
                place = np.searchsorted(hashes, asks)
                found = np.append(hashes, 0)[place] == asks
                c = np.where(found & (place < len(hashes)), counted[place], 0)[of].astype(np.float64)
                c[first[1:] - 1] = ends
                base = np.log10((c + 1) / (total + distinct_ + 1))
                model_ = own_model.word_log_probabilities(ids, first, begin)
                mixed = np.log10(COUNTS * c / max(1, total) + (1 - COUNTS) * np.exp(model_) + 1e-300)
                # Words too long for a double keep their logs.
                mixed = np.where(mixed < -290, model_ / np.log(10) + np.log10(1 - COUNTS), mixed)
                sums = [np.add.reduceat(x, first[:-1]) for x in (c > 0, base, mixed)]
                rows = batch.slice(a, b - a)
                out.append(pa.table([rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(b - a, total)), pa.array(sums[1]), pa.array(sums[2])], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = chunks.filter("words is null").select(F.col("chunk").alias("own"), "doc_id", "held_out", "ids")
    return texts.groupBy("own").cogroup(known.groupBy("at")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, str(public_tokenizers.path(TOKENIZER)))
