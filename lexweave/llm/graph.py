"""Connected components: of few edges on the driver, else by alternating large-star and small-star steps on an edge table.

Of more than FEW edges nothing is collected: each step is a grouped minimum (pre-aggregated before its shuffle) and a join
that adaptive execution may split at a hot node. Steps are written to the shared folder, and a step's
table goes when the next one is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store

#: Edges of longs (two megabytes) that are joined on the driver: a step over them takes longer to plan than to run, and each leaves its plans there.
FEW = 1 << 17


def _star(edges: DataFrame, small: bool) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(back)
    around = both.filter("b < a") if small else both
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = (around if small else both.filter("b > a")).join(least, "a")
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while (apart := least[x] != least[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(least[x], least[y]), np.minimum(least[x], least[y]))
        while (shorter := least[least]).tobytes() != least.tobytes():
            least = shorter
    return nodes, nodes[least]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): for each node of the edges (a, b), any orderable type, the least node that it reaches."""
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.schema["a"].dataType.typeName() == "long" and now.count() <= FEW:
        held = now.toArrow()
        discard(now)
        nodes, least = least_reached(*(held.column(c).to_numpy() for c in ("a", "b")))
        return now.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())}))
    seen = None
    while True:
        before, now = now, store(_star(_star(now, small=False), small=True), "stars")
        discard(before)
        state = now.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    # At rest every edge leads from a node to the least of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
