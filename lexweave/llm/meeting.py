"""Links between the members of shared buckets, without all pairs of a bucket.

Postings (token, id, size, matches, indexed), ids long, meet in rounds. In a round the ids of each token
meet CENTRES of them, chosen by hash anew each round, if those are of other components than their own.
Each id keeps the centre whose bitmap is nearest, and each two components at most CHANCES near ones of
such pairs, so that pairs grow with the components. Verified links join components. A round follows while WORTH of the
pairs of the last one link. Then all postings of a token meet whose ids are still
in different components. That is exact for components: a link inside one cannot change them. A large
group of near copies is joined by centres and makes few pairs at the end.

Of a pair the smaller set (then the lower id) must hold the token among its indexed ones. A pair is
verified if it shares as many tokens as the lower of its two `matches`, if its sizes are close enough, if
the bitmaps of its ids differ in few enough bits, and, where tokens are prefixes of ordered sets, if the
tokens left can still make up the overlap. The sizes and bitmaps are compared where the postings meet.
Near copies share long runs of such tokens, one after the other in both: they meet at the first token of a run alone, and
a bound of the run's length counts for its others. A bound is never less than the length, so that no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_hand, discard, store
from .graph import components

CENTRES, CHANCES = 4, 8
#: A round follows if such a share of the last one's pairs link, and FEW or more.
WORTH, FEW = 0.1, 8
#: A run of shared tokens is known to be longer or not than these lengths; of one longer than all, nothing is known.
LENGTHS = (1, 3, 7, 15)


def bits_apart(left: list[Column], right: list[Column]) -> Column:
    """The number of bits in which two bitmaps of longs differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True)), F.lit(0))


def with_runs(held: DataFrame) -> DataFrame:
    """held (id, token, pos and more) with `prev`, the token of the id before this one, and `after`: of each of LENGTHS, 16 bits of a hash of so many tokens that follow."""
    along = Window.partitionBy("id").orderBy("pos")
    next_ = [F.shiftrightunsigned(F.coalesce(F.bit_xor(F.xxhash64("token")).over(along.rowsBetween(1, n)), F.lit(0)), 48) for n in LENGTHS]
    after = next_[0]
    for k, x in enumerate(next_[1:], 1):
        after = after.bitwiseOR(F.shiftleft(x, 16 * k))
    return held.withColumns({"prev": F.lag("token").over(along), "after": after}).drop("pos")


def run_starts(x: str, y: str) -> Column:
    """Whether the shared token of two postings, by alias, is the first of a run: those of one before it have met there."""
    return ~F.coalesce(F.col(f"{x}.prev") == F.col(f"{y}.prev"), F.lit(False))


def run_bound(x: str, y: str) -> Column:
    """At least as many as the run of tokens that both share from here on has."""
    differ = F.col(f"{x}.after").bitwiseXOR(F.col(f"{y}.after"))
    out = F.lit(1 << 40)
    # A shorter run is the closer bound.
    for k, n in reversed(list(enumerate(LENGTHS))):
        out = F.when(F.shiftright(differ, 16 * k).bitwiseAND(F.lit(0xFFFF)) != 0, F.lit(n)).otherwise(out)
    return out.cast("long")


def linked(postings: DataFrame, bitmaps: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, ordered: bool, most_apart: Callable[[Column, Column], Column], fits: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Rows (node, component) of all ids that link. verify: pairs (a, b) to a stored table of those that link.

    bitmaps: id and the longs of its bitmap. most_apart: of the two sizes, in how many bits linked ids may differ.
    fits: whether two postings of a token, by alias, may make their ids link; they may have more columns.
    ordered: tokens are Jaccard prefixes, of ceil(percent * size / 100) - matches tokens less than the
    set, and the indexed ones of ceil(2 * percent * size / (100 + percent)) - matches less. `pos` is a token's place in them.
    """
    bits = [c for c in bitmaps.columns if c != "id"]
    centre_columns = [*(c for c in postings.columns if c not in ("token", "indexed", "matches", "pos")), "component", *bits]

    def apart(x: str, y: str) -> Column:
        return bits_apart([F.col(f"{x}.{b}") for b in bits], [F.col(f"{y}.{b}") for b in bits])

    def near(x: str, y: str) -> Column:
        size = [F.col(f"{c}.size") for c in (x, y)]
        close = (F.least(*size) * 100 >= F.greatest(*size) * percent) & (fits(x, y) if fits else F.lit(True))
        return close & (apart(x, y) <= most_apart(*size)) & (F.col(f"{x}.component") != F.col(f"{y}.component"))

    def picks(held: DataFrame, turn: int) -> DataFrame:
        """(a, b): ids and centres of their tokens, the nearest of their components."""
        if not ordered:
            # Of many tokens with few ids each: one shuffle for centres and join, of postings and not of several centres.
            held = held.repartition("token")
        centre = lambda k: F.min_by(F.struct(*centre_columns), F.xxhash64("id", F.lit(k)))
        found = held.groupBy("token").agg(F.array_distinct(F.array(*[centre(CENTRES * turn + k) for k in range(CENTRES)])).alias("c"))
        centres = found.select("token", F.explode("c").alias("c")).select("token", "c.*")
        met = held.alias("a").join(centres.alias("b"), (F.col("a.token") == F.col("b.token")) & near("a", "b"))
        each = met.select(F.col("a.id").alias("id"), F.col("b.id").alias("centre"), apart("a", "b").alias("apart"), F.col("a.component").alias("x"), F.col("b.component").alias("y"))
        # Shared tokens aren't counted: a centre of some need not be one of the others.
        best = each.groupBy("id").agg(F.min_by(F.struct("centre", "apart", "x", "y"), F.struct("apart", F.xxhash64("centre", F.lit(turn)))).alias("c")).select("id", "c.*")
        one = best.groupBy(F.least("x", "y"), F.greatest("x", "y"), F.pmod(F.xxhash64("id"), F.lit(CHANCES))).agg(F.min_by(F.struct("id", "centre"), F.struct("apart", "id", "centre")).alias("p"))
        return one.select(F.least("p.id", "p.centre").alias("a"), F.greatest("p.id", "p.centre").alias("b")).distinct()

    def all_apart(held: DataFrame) -> DataFrame:
        """(a, b): all ids of different components that meet in as many tokens as is demanded."""
        before = F.struct("a.size", "a.id") < F.struct("b.size", "b.id")
        first = run_starts("a", "b") if ordered else F.lit(True)
        met = held.alias("a").join(held.alias("b"), (F.col("a.token") == F.col("b.token")) & before & F.col("a.indexed") & first & near("a", "b"))
        rows = met.select(*[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("a", "b") for x in ("id", "size", "matches")], (run_bound("a", "b") if ordered else F.lit(1)).alias("run"))
        counted = rows.groupBy([c for c in rows.columns if c != "run"]).agg(F.sum("run").alias("k"))
        need = F.least("a_matches", "b_matches")
        if ordered:
            overlap = F.ceil(F.lit(percent) * (F.col("a_size") + F.col("b_size")) / (100 + percent) - 1e-9)
            left_a = F.ceil(F.lit(2 * percent) * F.col("a_size") / (100 + percent) - 1e-9) - F.col("a_matches")
            left_b = F.ceil(F.lit(percent) * F.col("b_size") / 100 - 1e-9) - F.col("b_matches")
            need = F.greatest(need, overlap - F.greatest(left_a, left_b))
        pairs = counted.filter(F.col("k") >= need)
        return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    # Tokens of one posting find nobody, and are most: counted alone, before anything else moves.
    shared = store(postings.groupBy("token").agg(F.count("*").alias("df"), F.max("indexed").alias("any")).filter("df > 1 and any").select("token"), "tokens")
    live = postings.join(at_hand(shared), "token")
    # Where tokens are many, their postings are stored once, with the bitmaps.
    live = store(live if ordered else live.join(bitmaps, "id"), "live")
    discard(shared)
    found, tried, turn, worth = None, None, 0, True
    while True:
        held = live.withColumn("component", F.col("id")) if found is None else live.join(at_hand(found).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        if found is not None:
            mixed = store(held.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token", "n"), "mixed")
            # After the first round, centres are for tokens of more ids than they are.
            crowded = mixed.filter(F.col("n") > 2 * CENTRES) if worth else mixed
            held = held.join(at_hand(crowded.select("token")), "token")
        if ordered:
            held = held.join(bitmaps, "id")
        if ordered or found is not None:
            held = store(with_runs(held) if ordered and not worth else held, "held")
        if not worth:
            break
        pairs = picks(held, turn)
        pairs = store(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = verify(pairs)
        known = links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        n = links.count()
        worth = n >= max(FEW, WORTH * pairs.count())
        if ordered or found is not None:
            discard(held)
        found, turn = store(components(known), "components"), turn + 1
    links = verify(store(all_apart(held).join(tried, ["a", "b"], "left_anti"), "pairs"))
    discard(held, live)
    return components(links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
