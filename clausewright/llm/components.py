"""Connected components of an edge table by alternating star contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import cut, discard


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is its least node.

    Each round points every node's larger neighbours at its least one, then every node's smaller ones at it. Rounds are written to
    the shared folder, so plans stay short and a lost executor costs one round at most. The number of rounds follows the logarithm of
    the largest component's diameter; when the edges stay the same they are stars, and the result. Loops and repeated edges don't matter.
    The result reads the last round's table, which discard() on it deletes.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    was = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old, e = e, cut(low.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))).distinct(), "edges")
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components didn't settle")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
