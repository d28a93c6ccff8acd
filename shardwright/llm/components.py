"""Connected components of an edge table by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): large-star links every
larger neighbour of a node to the node's least neighbour, small-star links the smaller ones and
the node itself. Edges never grow in number, and a logarithmic number of rounds suffices in
practice. A node of many edges is only ever aggregated by ``min`` and ``count``, which combine
before the shuffle, and joined by broadcast, so its edges never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import materialize, packed


#: A node with more than this share of the edges is joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 0.001


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges joined with ``least`` (``u, m, n``) of their ``u``: those of hot nodes where they lie, the others by shuffle."""
    hot = F.broadcast(least.where(F.col("n") >= max(2.0, HOT_SHARE * total)))
    near = edges.join(hot.drop("n"), "u")
    far = edges.join(F.broadcast(least.where(F.col("n") >= max(2.0, HOT_SHARE * total)).select("u")), "u", "left_anti")
    return near.unionByName(far.join(least.drop("n"), "u"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    linked = _with_least(both.where("v > u"), least, 2 * total)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    # Every edge points from the larger to the smaller node here.
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = _with_least(edges, least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node that has an edge to another; a component is named by its least node.

    Loops and repeated edges are ignored, as is the order within an edge; rows with a null end
    are dropped. No edges give an empty result.
    """
    current = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    current = materialize(current.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    state = seen = (current.count(), None)
    current = packed(current, state[0])
    for _ in range(max_rounds if state[0] else 0):
        # Edges grow no more in number.
        wide = materialize(packed(_large_star(current, state[0]), state[0]))
        current = materialize(packed(_small_star(wide, state[0]), state[0]))
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        if state[0]:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
