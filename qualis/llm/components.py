"""Connected components of an edge table by alternating large-star and small-star.

Both steps keep the components of the graph; at the fixed point every component
is a star around its smallest node. Each step is one grouped minimum (partial
aggregates, so a hot node costs one row per task) and a join of these minima to the edges: those of
hubs, nodes with over 1 / HUBS of the edges (so at most HUBS of them), by broadcast, where the edges
lie; the others by a shuffle, in which no node has more than that share. The edges are stored after each round in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored



HUBS = 1000


def _with_least(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) and (u, m): m is the least v of u; `edges` has n rows."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    hubs = low.where(F.col("k") * HUBS > n).select("u", "m")
    others = low.where(F.col("k") * HUBS <= n).select("u", F.col("m").alias("m2"))
    found = edges.join(F.broadcast(hubs), "u", "left")
    rest = found.where("m IS NULL").drop("m").join(others, "u").withColumnRenamed("m2", "m")
    return found.where("m IS NOT NULL").unionByName(rest), low.select("u", "m")


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Small-star: link every node's smaller neighbours, and itself, to the smallest of them."""
    linked, low = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Large-star: link every node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked, _ = _with_least(both, 2 * n)
    return linked.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of `edges` (long columns u, v); root is the smallest node."""
    edges = stored(edges.where("u != v").select("u", "v").distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        # large-star gives at most as many edges as there are
        edges = stored(_small(_large(edges, state[0]), state[0]).where("u != v").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
