"""Communities of an entity graph."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.components import connected_components
from lexigrid.operators.graph import both_ways, degree, rank_in
from lexigrid.shipping import ship
from lexigrid.storage import materialise

#: Components with more edges than this are given to label propagation, which needs no single task to hold one.
LOCAL_EDGES = 2_000_000


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``(node, community)``: in each round every node takes the label that most of its edges lead to, ties to the least label."""
    two = materialise(both_ways(edges), "adjacent")
    label = two.select("node").distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = two.join(label.withColumnRenamed("node", "other"), "other").groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        label = materialise(votes.withColumn("k", rank_in([F.col("node")], F.desc("n"), F.col("community"))).where("k = 1").select("node", "community"), "labels")
    return label


def louvain(edges: list[tuple], resolution: float = 1.0) -> dict:
    """Node to part, by local moving and aggregation until modularity stops rising; nodes in order, ties to the least part."""
    weight: dict = defaultdict(float)
    for u, v, w in edges:
        weight[(u, v) if u <= v else (v, u)] += w
    names = sorted({n for e in weight for n in e})
    at = {n: i for i, n in enumerate(names)}
    graph = [defaultdict(float) for _ in names]
    loops = [0.0] * len(names)
    for (u, v), w in sorted(weight.items()):
        if u == v:
            loops[at[u]] += w
        else:
            graph[at[u]][at[v]] += w
            graph[at[v]][at[u]] += w
    part_of = list(range(len(names)))
    total = sum(loops) + sum(map(lambda g: sum(g.values()), graph)) / 2
    while total:
        k = [2 * loops[i] + sum(g.values()) for i, g in enumerate(graph)]
        part, size = list(range(len(graph))), k[:]
        moved = improved = True
        improved = False
        while moved:
            moved = False
            for i, g in enumerate(graph):
                own = part[i]
                size[own] -= k[i]
                to: dict = defaultdict(float)
                to[own] += 0.0
                for j, w in g.items():
                    to[part[j]] += w
                gain = {c: w - resolution * k[i] * size[c] / (2 * total) for c, w in to.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                size[best] += k[i]
                if best != own:
                    part[i], moved, improved = best, True, True
        if not improved:
            break
        dense = {c: n for n, c in enumerate(dict.fromkeys(part))}
        part = [dense[c] for c in part]
        part_of = [part[p] for p in part_of]
        graph2, loops2 = [defaultdict(float) for _ in dense], [0.0] * len(dense)
        for i, g in enumerate(graph):
            loops2[part[i]] += loops[i]
            for j, w in g.items():
                if part[i] == part[j]:
                    loops2[part[i]] += w / 2
                else:
                    graph2[part[i]][part[j]] += w
        graph, loops = graph2, loops2
    return {n: part_of[i] for i, n in enumerate(names)}


def communities(edges: DataFrame, resolution: float = 1.0, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, community)``; a community is named by its least node.

    No community spans two connected components, so each component is one
    group, optimised for modularity in memory. Components of more than ``local_edges`` edges go
    to label propagation instead.
    """
    ship(edges.sparkSession)
    e = edges.select("src", "dst", F.coalesce(F.col("weight") if "weight" in edges.columns else F.lit(1.0), F.lit(1.0)).cast("double").alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL")
    comp = materialise(connected_components(e), "components")
    placed = materialise(e.join(comp.withColumnRenamed("node", "src"), "src"), "placed")
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(size.where(F.col("n") > local_edges).select("component"), "large")
    kind = dict(e.dtypes)["src"]

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        part = louvain(list(zip(t["src"], t["dst"], t["weight"])), resolution)
        least: dict = {}
        for n, p in part.items():
            least[p] = min(least.get(p, n), n)
        return pd.DataFrame({"node": list(part), "community": [least[p] for p in part.values()]})

    out = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(solve, f"node {kind}, community {kind}")
    if large.isEmpty():
        return out
    return out.unionByName(label_propagation(placed.join(large, "component", "left_semi")))


def sub_communities(edges: DataFrame, assigned: DataFrame, min_nodes: int = 4, min_size: int = 2) -> DataFrame:
    """``(node, community, sub_id)``: communities of ``min_nodes`` or more are split once more; parts are numbered by their least node.

    Parts under ``min_size`` join the part that most of their edges lead to (ties to the least), else the largest other part. Where
    fewer than two parts remain, ``sub_id`` is null.
    """
    ship(edges.sparkSession)
    a = assigned.select("node", "community")
    inner = edges.join(a.select(F.col("node").alias("src"), F.col("community").alias("c")), "src").join(a.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst").where("c = c2")
    kind = dict(a.dtypes)["node"]

    def split(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": pd.Series([], dtype=object), "sub_id": pd.Series([], dtype="int32")})
        pairs = list(zip(t["src"], t["dst"]))
        nodes = {n for p in pairs for n in p}
        if len(nodes) < min_nodes:
            return none
        part = merge_small(louvain([(u, v, 1.0) for u, v in pairs], 1.0), pairs, min_size)
        least: dict = {}
        for n, p in part.items():
            least[p] = min(least.get(p, n), n)
        order = {p: i for i, p in enumerate(sorted(least, key=least.get))}
        if len(order) < 2:
            return none
        return pd.DataFrame({"node": list(part), "sub_id": [order[p] for p in part.values()]})

    subs = inner.select("c", "src", "dst").groupBy("c").applyInPandas(split, f"node {kind}, sub_id int")
    return a.join(subs, "node", "left")


def merge_small(part: dict, edges: list[tuple], min_size: int = 2) -> dict:
    """Parts under ``min_size`` go where most of their outgoing edges lead, by the partition as it was given."""
    size: dict = defaultdict(int)
    for p in part.values():
        size[p] += 1
    small = {p for p, n in size.items() if n < min_size}
    if not small or len(size) < 2:
        return dict(part)
    leads: dict = defaultdict(lambda: defaultdict(int))
    for u, v in edges:
        if part[u] in small and part[v] != part[u]:
            leads[part[u]][part[v]] += 1
    to = {}
    for p in small:
        if leads[p]:
            to[p] = min(leads[p], key=lambda c: (-leads[p][c], c))
        else:
            to[p] = min((c for c in size if c != p), key=lambda c: (-size[c], c))
    return {n: to.get(p, p) for n, p in part.items()}


def boundary_target(edges: DataFrame, assigned: DataFrame, min_size: int = 2) -> DataFrame:
    """``(community, target)`` for each part under ``min_size`` that has an edge out: where most of them lead, ties to the least."""
    size = assigned.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    small = size.where(F.col("n") < min_size).select("community")
    src = assigned.select(F.col("node").alias("src"), F.col("community"))
    dst = assigned.select(F.col("node").alias("dst"), F.col("community").alias("target"))
    out = edges.join(src, "src").join(small, "community", "left_semi").join(dst, "dst").where("community <> target")
    votes = out.groupBy("community", "target").agg(F.count(F.lit(1)).alias("n"))
    return votes.withColumn("k", rank_in([F.col("community")], F.desc("n"), F.col("target"))).where("k = 1").select("community", "target")


def degree_bins(edges: DataFrame, bins: int = 4) -> DataFrame:
    """``(node, community)``: quarters of the greatest degree; the fallback where no optimiser fits."""
    d = degree(edges)
    top = d.agg(F.max("degree").alias("m"))
    # one row
    return d.crossJoin(F.broadcast(top)).select("node", F.least((F.col("degree") / (F.col("m") / bins)).cast("int"), F.lit(bins - 1)).alias("community"))


def local_numbers(assigned: DataFrame) -> DataFrame:
    """``(node, community_id)``: communities numbered from 0 by their least node. The numbering sorts one row a community."""
    from pyspark.sql import Window

    least = assigned.groupBy("community").agg(F.min("node").alias("least"))
    numbered = least.select("community", (F.row_number().over(Window.orderBy("least")) - 1).alias("community_id"))
    return assigned.join(numbered, "community").select("node", "community_id")


def modularity(edges: DataFrame, assigned: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(modularity)`` of a partition of a directed graph; a missing weight is 1."""
    w = F.coalesce(F.col("weight") if "weight" in edges.columns else F.lit(1.0), F.lit(1.0))
    e = edges.select("src", "dst", w.alias("w"))
    e = e.join(assigned.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(assigned.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), F.col("w").alias("out"), F.lit(0.0).alias("into"), F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0).alias("inner")), F.struct(F.col("cd").alias("c"), F.lit(0.0).alias("out"), F.col("w").alias("into"), F.lit(0.0).alias("inner")))).alias("x")).select("x.*")
    sums = ends.groupBy("c").agg(F.sum("out").alias("o"), F.sum("into").alias("i"), F.sum("inner").alias("l"))
    return sums.agg((F.sum("l") / F.sum("o") - resolution * F.sum(F.col("o") * F.col("i")) / (F.sum("o") * F.sum("o"))).alias("modularity"))
