"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.storage import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = least node id.

    Each round is two groupings over the edge list, so work follows the edges;
    rounds grow with the logarithm of the longest path. Null ends and
    self-loops carry no connection: a node that has only a self-loop forms its
    own component, an edge with a null end is ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes_alone = e.where("u = v").select(F.col("u").alias("node"))
    cur = materialise(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: each neighbour above u is hung on u's least neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and the neighbours below it are hung on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(state) == before:
            break
        before = tuple(state)
    linked = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = nodes_alone.select("node", F.col("node").alias("component"))
    return linked.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
