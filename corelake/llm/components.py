"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b: long); component is the smallest node reachable.

    Each round writes its links to the shared folder, so that neither the plan grows nor a lost executor
    repeats earlier rounds. A hub's neighbours are never gathered: each step is a minimum per node (combined
    before the shuffle) joined back to the links. The number of rounds is logarithmic in a component's width.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    for _ in range(most_rounds):
        # done when the links are stars: no node has two links down, or links both up and down; since links
        # join nodes of one component only, and lead to smaller nodes, each centre is its component's smallest
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if ends.where("down > 1 or (down > 0 and up > 0)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each neighbour above u is linked to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours are linked to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = written(small, "links")
        discard(edges)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
