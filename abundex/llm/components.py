"""Connected components of an edge table by alternating large and small stars.

Edges are first contracted within partitions by union-find, then every round is two aggregations with partial sums and
two joins whose sides are stored, so that a hub's edges can be split between tasks. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import forget, keep


def contract(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Star edges (u, v), u > v, with the same components as the edges of each partition, block by block."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        def stars():
            pairs = [(x, find(x)) for x in list(parent)]
            u, v = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist()):
                x, y = find(u), find(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    parent.setdefault(min(x, y), min(x, y))
            if len(parent) > block:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges have u > v. Large: neighbours above u go to u's least neighbour; small: those below u do."""
    near = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else edges
    least = keep(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least", n)
    both = near.join(least, "u")
    out = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else both.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
    kept = keep(out.where("u > v").distinct(), "cc", n)
    forget(least)
    return kept


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex that isn't the least of its component; edges are (u, v) longs. The rounds end when
    one changes nothing, after about log2 of the longest path."""
    e = keep(contract(edges).distinct(), "cc", edges.count())
    n = e.count()
    state = None
    while True:
        big = _star(e, True, n)
        forget(e)
        e = _star(big, False, n)
        forget(big)
        new = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
        state = new
