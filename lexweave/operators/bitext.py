"""Segments, bisegment tables, their evaluation, and alignment of segment sequences.

A bisegment is (pair_id, bis_no, l1_start, l1_len, l2_start, l2_len), starts from 1; a side without
segments has length 0 and a null start.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The length model, step priors and costs of differing numbers.
RATIO, SLOPE, OFFSET, CUTOFF = 1.0753, 6.31, 195.0, 8.28
STEPS = {(1, 1): 1.0, (1, 2): 0.0118, (2, 1): 0.0058, (2, 2): 0.001, (3, 1): 2 / 8500, (3, 2): 1 / 8500, (1, 3): 2 / 85000, (0, 1): 1 / 85000, (1, 0): 1 / 85000, (2, 3): 1 / 85000}
NUMBER_COSTS = (0.0, 3.435, 5.032, 6.383, 7.631, 8.82)
ANCHOR_CHARS = 70

LINKS = "pair_id long, bis_no int, l1_start int, l1_len int, l2_start int, l2_len int, cost double"


def segments(docs: DataFrame, boundary: str = "\n") -> DataFrame:
    """(doc_id, lang, seg_no, text, len)."""
    rows = docs.select("doc_id", "lang", F.posexplode(F.split("text", boundary, -1)).alias("p", "text"))
    return rows.select("doc_id", "lang", (F.col("p") + 1).alias("seg_no"), "text", F.length("text").alias("len"))


def combined_lengths(segs: DataFrame, most: int = 3) -> DataFrame:
    """len1..len<most>: characters of so many segments from each on, 0 past the end."""
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    each = [F.when(F.col("seg_no") + k - 1 <= n, F.sum("len").over(w.rowsBetween(0, k - 1))).otherwise(0).cast("long").alias(f"len{k}") for k in range(1, most + 1)]
    return segs.select("doc_id", "seg_no", *each)


def individual_links(bis: DataFrame) -> DataFrame:
    """(pair_id, s1, s2): the product of both sides' segments; a null for a side without."""
    side = lambda s: F.when(F.col(f"{s}_len") > 0, F.sequence(F.col(f"{s}_start"), F.col(f"{s}_start") + F.col(f"{s}_len") - 1))
    return bis.select("pair_id", F.explode_outer(side("l1")).alias("s1"), side("l2").alias("r")).select("pair_id", "s1", F.explode_outer("r").alias("s2"))


def with_texts(bis: DataFrame, segs: DataFrame, between: str = " ") -> DataFrame:
    """`bis` with l1_text and l2_text: what its segments (pair_id, side 1 or 2, seg_no, text) say, in order.

    Missing segments are left out, a null text is an empty one, and a side without segments is empty.
    """

    def side(k: int) -> DataFrame:
        first = F.col(f"l{k}_start")
        return bis.filter(F.col(f"l{k}_len") > 0).select("pair_id", "bis_no", F.lit(k).alias("side"), F.explode(F.sequence(first, first + F.col(f"l{k}_len") - 1)).alias("seg_no"))

    def said(k: int):
        own = F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("seg_no", "text"))))
        return F.array_join(F.transform(own, lambda s: s["text"]), between).alias(f"l{k}_text")

    texts = segs.select("pair_id", "side", "seg_no", F.coalesce("text", F.lit("")).alias("text"))
    found = side(1).unionByName(side(2)).join(texts, ["pair_id", "side", "seg_no"]).groupBy("pair_id", "bis_no").agg(said(1), said(2))
    return bis.join(found, ["pair_id", "bis_no"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("l1_text", "l2_text")})


def one_to_one(l1: DataFrame, l2: DataFrame) -> DataFrame:
    """Bisegments of each two segments (pair_id, seg_no) of the same number; what one side has more of stands alone."""
    side = lambda x, k: x.select("pair_id", "seg_no", F.lit(1).alias(f"l{k}_len"))
    both = side(l1, 1).join(side(l2, 2), ["pair_id", "seg_no"], "full")
    part = lambda k: [F.when(F.col(f"l{k}_len") == 1, F.col("seg_no")).alias(f"l{k}_start"), F.coalesce(f"l{k}_len", F.lit(0)).alias(f"l{k}_len")]
    return both.select("pair_id", F.col("seg_no").alias("bis_no"), *part(1), *part(2))


def short_pairs(pairs: DataFrame, below: int = ANCHOR_CHARS, more_than: int = 3) -> DataFrame:
    """(s1, s2, n): in how many documents a pair (doc, s1, s2) of texts below so many characters stands, if in more than `more_than`."""
    short = pairs.filter((F.length("s1") < below) & (F.length("s2") < below))
    each = short.select("doc", *[F.lower(F.trim(c)).alias(c) for c in ("s1", "s2")]).distinct()
    return each.groupBy("s1", "s2").agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def translations(pairs: DataFrame) -> DataFrame:
    """(s1, n, s2): of each text of (s1, s2, n) its partners, from the most frequent, ties by text, and how often it has any."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "s2")))
    return pairs.groupBy("s1").agg(F.sum("n").alias("total"), F.transform(ranked, lambda x: x["s2"]).alias("all")).select("s1", F.col("total").alias("n"), F.col("all").alias("s2"))


def precision_recall(gold: DataFrame, made: DataFrame) -> DataFrame:
    """One row: tp, n_gold, n_made, precision, recall, f1 of individual links; null sides are equal."""
    g, m = individual_links(gold).distinct(), individual_links(made).distinct()
    on = (F.col("g.pair_id") == F.col("m.pair_id")) & F.col("g.s1").eqNullSafe(F.col("m.s1")) & F.col("g.s2").eqNullSafe(F.col("m.s2"))
    hit = g.alias("g").join(m.alias("m"), on, "left_semi").agg(F.count("*").alias("tp"))
    out = hit.crossJoin(g.agg(F.count("*").alias("n_gold"))).crossJoin(m.agg(F.count("*").alias("n_made")))
    p, r = F.try_divide(F.col("tp").cast("double"), "n_made"), F.try_divide(F.col("tp").cast("double"), "n_gold")
    return out.select("tp", "n_gold", "n_made", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def breaks(bis: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair_id, side, bis_no): where a side doesn't start at 1, go on where it stopped, or end at its size (pair_id, n1, n2)."""
    out = None
    for side, n in (("l1", "n1"), ("l2", "n2")):
        w = Window.partitionBy("pair_id").orderBy("bis_no")
        rows = bis.filter(F.col(f"{side}_len") > 0).join(sizes, "pair_id")
        end = F.col(f"{side}_start") + F.col(f"{side}_len")
        bad = (F.col(f"{side}_start") != F.coalesce(F.lag(end).over(w), F.lit(1))) | (F.lead(F.lit(1)).over(w).isNull() & (end != F.col(n) + 1))
        one = rows.withColumn("bad", bad).filter("bad").select("pair_id", F.lit(side).alias("side"), "bis_no")
        out = one if out is None else out.unionByName(one)
    return out


def difference_runs(gold: DataFrame, made: DataFrame) -> DataFrame:
    """(run_len, n): lengths of runs of consecutive gold bisegments that were not made."""
    keys = ["pair_id", "l1_start", "l1_len", "l2_start", "l2_len"]
    on = None
    for k in keys:
        c = F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}"))
        on = c if on is None else on & c
    missed = gold.alias("g").join(made.alias("m"), on, "left_anti")
    island = F.col("bis_no") - F.row_number().over(Window.partitionBy("pair_id").orderBy("bis_no"))
    return missed.withColumn("island", island).groupBy("pair_id", "island").agg(F.count("*").alias("run_len")).groupBy("run_len").agg(F.count("*").alias("n"))


def length_cost(a: int, b: int) -> float:
    """Negative log of the chance of so unlike lengths; infinite beyond the cutoff, 0 for two empty sides."""
    if a == b == 0:
        return 0.0
    mean = (a + b) / 2
    delta = abs((b - RATIO * a) / math.sqrt(max(mean, SLOPE * mean - OFFSET)))
    return math.inf if delta > CUTOFF else -math.log(math.erfc(delta / math.sqrt(2)))


def number_cost(d: int) -> float:
    return NUMBER_COSTS[d] if d < len(NUMBER_COSTS) else d + 4.0


_STEPS = sorted(((-math.log(p), a, b) for (a, b), p in STEPS.items()), key=lambda s: s[0])


def align_gap(len1: list[int], len2: list[int], nums1: list[set] | None = None, nums2: list[set] | None = None) -> list[tuple[int, int, int, int, float]]:
    """(start1, n1, start2, n2, cost so far), from 0, by banded dynamic programming; ties take the likelier step."""
    n1, n2 = len(len1), len(len2)
    margin = int(2 * math.log(n1)) if n1 else 0
    right, left = max(0, n2 - n1) + margin + 1, max(0, n1 - n2) + margin + 1
    if not n1:
        right = n2 + 1
    cost, came = np.full((n1 + 1, n2 + 1), math.inf), {}
    cost[0, 0] = 0.0
    sum1, sum2 = np.concatenate(([0], np.cumsum(len1))), np.concatenate(([0], np.cumsum(len2)))
    for i in range(n1 + 1):
        for j in range(max(0, i - left), min(n2 + 1, i + right)):
            for prior, a, b in _STEPS:
                if a > i or b > j:
                    continue
                value = cost[i - a, j - b] + prior
                if value >= cost[i, j]:
                    continue
                if a and b:
                    value += length_cost(int(sum1[i] - sum1[i - a]), int(sum2[j] - sum2[j - b]))
                    if nums1 is not None and value < cost[i, j]:
                        value += number_cost(len(set().union(*nums1[i - a : i]) ^ set().union(*nums2[j - b : j])))
                if value < cost[i, j]:
                    cost[i, j], came[i, j] = value, (a, b)
    if (n1 or n2) and (n1, n2) not in came:  # nothing fits the length model: one side after the other
        return [(i, 1, 0, 0, math.inf) for i in range(n1)] + [(0, 0, j, 1, math.inf) for j in range(n2)]
    out, i, j = [], n1, n2
    while i or j:
        a, b = came[i, j]
        out.append((i - a, a, j - b, b, float(cost[i, j])))
        i, j = i - a, j - b
    return out[::-1]


def find_anchors(t1: list[str], t2: list[str], exact: dict[str, list[str]], patterns: list[tuple]) -> list[tuple[int, int]]:
    """Indexes of short texts, unique on either side, that a dictionary or a pattern (least, most, regex, format, groups) joins in order.

    Equal text that a pattern matches joins as well. Then repaired: of two anchors of which one side alone
    is adjacent both go; where both gaps are 2, the pair between joins them.
    """

    def usable(texts: list[str]) -> dict[str, int]:
        keys: dict[str, int] = {}
        for i, t in enumerate(texts):
            if len(t) < ANCHOR_CHARS and (k := t.strip().lower()):
                keys[k] = -1 if k in keys else i
        return keys

    k1, k2 = usable(t1), usable(t2)
    found: list[tuple[int, int]] = []
    for key, i in sorted(((k, i) for k, i in k1.items() if i >= 0), key=lambda x: x[1]):
        last, j = (found[-1][1] if found else -1), None
        if key in exact:
            hits = [k2[t] for t in exact[key] if t in k2]
            j = hits[0] if len(hits) == 1 and hits[0] >= 0 else None
        else:
            for least, most, pattern, form, groups in patterns:
                if least > len(key):
                    break
                if most >= len(key) and (m := re.fullmatch(pattern, key)):
                    j = k2.get(form.format(*[m[g] for g in groups]), k2.get(key))
                    break
        if j is not None and j > last:
            found.append((i, j))
    out, skip = [], False
    for a, b in zip(found, found[1:], strict=False):
        gaps = (b[0] - a[0], b[1] - a[1])
        apart = (gaps[0] == 1) != (gaps[1] == 1)
        if not skip and not apart:
            out.append(a)
            if gaps == (2, 2):
                out.append((a[0] + 1, a[1] + 1))
        skip = apart
    return out + ([found[-1]] if found and not skip else [])


def align_texts(t1: list[str], t2: list[str], nums1=None, nums2=None, exact: dict | None = None, patterns: list | None = None, use_anchors: bool = True) -> list[tuple]:
    """Rows (l1_start, l1_len, l2_start, l2_len, cost) for two sequences of segments; anchors are 1:1, and gaps are aligned alone."""
    anchors = find_anchors(t1, t2, exact or {}, patterns or []) if use_anchors else []
    out = []
    for (a, b), (c, d) in zip([(-1, -1), *anchors], [*anchors, (len(t1), len(t2))], strict=True):
        gap = align_gap([len(t) for t in t1[a + 1 : c]], [len(t) for t in t2[b + 1 : d]], *([nums1[a + 1 : c], nums2[b + 1 : d]] if nums1 is not None else []))
        out += [(a + 2 + i if n else None, n, b + 2 + j if m else None, m, cost) for i, n, j, m, cost in gap]
        if c < len(t1) or d < len(t2):
            out.append((c + 1, 1, d + 1, 1, 0.0))
    return out


def anchor_totals(pairs: DataFrame, exact: dict | None = None, patterns: list | None = None) -> DataFrame:
    """One row (pairs, anchors, partials): anchors of all pairs (pair_id, side, seg_no, text), and the gaps between them that are aligned alone."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_no", kind="stable")
        texts = [[t or "" for t in pdf[pdf["side"] == s]["text"]] for s in (1, 2)]
        found = find_anchors(*texts, exact or {}, patterns or [])
        ends = zip([(-1, -1), *found], [*found, (len(texts[0]), len(texts[1]))], strict=True)
        return pd.DataFrame({"anchors": [len(found)], "partials": [sum(c - a > 1 or d - b > 1 for (a, b), (c, d) in ends)]})

    each = pairs.groupBy("pair_id").applyInPandas(one, "anchors long, partials long")
    return each.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors"), F.coalesce(F.sum("partials"), F.lit(0)).alias("partials"))


def align(pairs: DataFrame, numbering: bool = True, use_anchors: bool = True, exact: dict | None = None, patterns: list | None = None) -> DataFrame:
    """LINKS of segments (pair_id, side 1 or 2, seg_no, text). One pair of documents is one group."""
    rows = pairs.withColumn("nums", T.number_set(T.tokens(F.col("text"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_no", kind="stable")
        sides = [pdf[pdf["side"] == s] for s in (1, 2)]
        nums = [[set(x) for x in s["nums"]] for s in sides] if numbering else [None, None]
        links = align_texts(*[[t or "" for t in s["text"]] for s in sides], *nums, exact=exact, patterns=patterns, use_anchors=use_anchors)
        return pd.DataFrame([(pdf["pair_id"].iloc[0], k + 1, *x) for k, x in enumerate(links)], columns=["pair_id", "bis_no", "l1_start", "l1_len", "l2_start", "l2_len", "cost"]).astype({"l1_start": "Int32", "l2_start": "Int32"})

    return rows.groupBy("pair_id").applyInPandas(one, LINKS)
