"""Connected components of a graph of links, by alternating stars; no component or link list leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import written

#: Links of a node from which it counts as hot. With more edges the least number grows, so that at most 2 * HOT_NODES nodes are.
HOT_LINKS, HOT_NODES = 256, 500_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, hot_from: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, d): hot nodes, bounded in number by their links d, come by a broadcast and the rest by a join."""
    hot = F.broadcast(least.filter(F.col("d") > hot_from).select("u", "m"))
    cold = least.filter(F.col("d") <= hot_from).select("u", "m")
    return edges.join(hot, "u").unionByName(edges.join(hot.select("u"), "u", "left_anti").join(cold, "u"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (u, v), two columns of one orderable type, any direction. Returns node, component (its smallest node), for nodes with links.

    Each round hangs larger neighbours on the smallest node around (large star), then every node and its smaller
    neighbours on the smallest of them (small star), until the edges repeat; they are then stars around the components'
    smallest nodes. Minima are pre-aggregated before the shuffle; edges of hot nodes are never shuffled by the node.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    last = None
    for _ in range(most_rounds):
        now = _digest(edges)
        if now == last or not now[0]:
            break
        last = now
        hot_from = max(HOT_LINKS, now[0] // HOT_NODES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = _with_least(both.filter("v > u"), least, hot_from).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = _with_least(large, low, hot_from).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
