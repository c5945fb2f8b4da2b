"""Graph algebra on edge tables ``(src, dst[, weight])``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.vectors import matrix
from lexigrid.operators.components import connected_components
from lexigrid.shipping import release, ship
from lexigrid.storage import discard, materialise, spread, tasks

VITAL = ("DAY", "SEGMENT", "EPISODE", "TOPIC", "SUBTOPIC")
BLOCK_ROWS = 4096
#: Rows of a block that meet the other block at once.
TILE_ROWS = 128
#: Rows of a frontier, and sources of edges, that every executor may hold at once.
FRONTIER, SOURCES = 100_000, 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    """``(node, other)``: each edge from either end, a self-loop once."""
    e = edges.select("src", "dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other")))


def degree(edges: DataFrame) -> DataFrame:
    """``(node, degree)``: ends of edges at each node; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def with_endpoints(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select(F.col(key).alias("_id"))
    return edges.join(ids.withColumnRenamed("_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("_id", "dst"), "dst", "left_semi").select(*edges.columns)


def similarity_pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b, similarity)`` of all pairs a < b with at least that cosine.

    Exact. Rows are dealt to blocks; each pair of blocks meets in one task, some rows of one with all
    of the other at a time. Memory of a task is bounded by the block and what such a strip gives, and the
    tasks grow with the square of the blocks, as the comparisons do.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    blocks = max(1, -(-rows.count() // block_rows))
    placed = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = placed.select("id", "v", "p", F.explode(others).alias("q")).select("id", "v", "p", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    kind = dict(rows.dtypes)["id"]

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        sides = [t.filter(pc.equal(t["p"], k)) for k in (i, j)]
        left, right = (s["id"].combine_chunks() for s in sides)
        u, v = (unit(matrix(s["v"].combine_chunks())) if len(s) else None for s in sides)
        del t, sides
        if len(left) and len(right):
            yield from _strips(left, u, right, v, threshold, i == j)
        release()

    return dealt.groupBy("i", "j").applyInArrow(meet, f"a {kind}, b {kind}, similarity double")


def _strips(left: pa.Array, u: np.ndarray, right: pa.Array, v: np.ndarray, threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of unit vectors, or of one block with itself, a strip of rows at a time."""
    for k in range(0, len(left), TILE_ROWS):
        s = u[k : k + TILE_ROWS] @ v.T
        x, y = np.nonzero(s >= threshold)
        a, b, found = left.take(pa.array(x + k)), right.take(pa.array(y)), pa.array(s[x, y])
        ordered = pc.less(a, b)
        keep = ordered if same else pc.not_equal(a, b)
        yield pa.RecordBatch.from_arrays([pc.if_else(ordered, a, b).filter(keep), pc.if_else(ordered, b, a).filter(keep), found.filter(keep)], ["a", "b", "similarity"])


def clusters(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of nodes that have a similar one."""
    return connected_components(pairs, "a", "b")


def pick_canonical(members: DataFrame, degrees: DataFrame, name: str = "name") -> DataFrame:
    """``(node, canonical)`` of ``(node, component, name)``: the canonical one has the most edges, then the longest name, then the least id."""
    m = members.join(degrees, "node", "left").select("node", "component", name, F.coalesce("degree", F.lit(0)).alias("degree"))
    best = m.groupBy("component").agg(F.min_by("node", F.struct((-F.col("degree")).alias("d"), (-F.length(name)).alias("l"), F.col("node").alias("n"))).alias("canonical"))
    return m.join(best, "component").select("node", "canonical")


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after each node of ``(node, canonical)`` has become its canonical one.

    What joined two different nodes that are one now is gone; a self-loop stays
    one. Of parallel edges one stays, with the attributes of the one that was there
    already (else of the least), and the greatest weight, a missing one counting as 1.
    """
    extra = [c for c in edges.columns if c not in ("src", "dst", "weight")]
    m = mapping.where("node <> canonical")
    e = edges.join(m.select(F.col("node").alias("src"), F.col("canonical").alias("_s")), "src", "left").join(m.select(F.col("node").alias("dst"), F.col("canonical").alias("_d")), "dst", "left")
    e = e.withColumns({"_s": F.coalesce("_s", "src"), "_d": F.coalesce("_d", "dst")}).where("_s <> _d OR src = dst")
    there = F.struct(((F.col("src") != F.col("_s")) | (F.col("dst") != F.col("_d"))).alias("moved"), "src", "dst", *extra)
    weight = F.when(F.count(F.lit(1)) > 1, F.max(F.coalesce("weight", F.lit(1.0)))).otherwise(F.max("weight"))
    out = e.groupBy("_s", "_d").agg(weight.alias("weight"), F.min(there).alias("t"))
    return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight", *[F.col(f"t.`{c}`").alias(c) for c in extra])


def merge_aliases(nodes: DataFrame, mapping: DataFrame, key: str = "id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """``(canonical, aliases)``: names, alias lists and ids (but generated ones) of all merged into each canonical node."""
    m = mapping.where("node <> canonical")
    own = F.when(~F.col(key).rlike("^(ENTITY_|PLACE_)"), F.array(key)).otherwise(F.array().cast("array<string>"))
    said = F.concat(F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.filter(F.array(name), lambda x: x.isNotNull()), own)
    rows = nodes.select(F.col(key).alias("node"), said.alias("said")).join(m, "node")
    return rows.groupBy("canonical").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("said")))).alias("aliases"))


def prune_edges(edges: DataFrame, least: float = 0.01) -> DataFrame:
    """Without edges of a numeric weight under ``least``; other weights stay."""
    w = F.col("weight").try_cast("double")
    return edges.where(w.isNull() | (w >= least))


def prune_isolated(nodes: DataFrame, edges: DataFrame, vital: tuple[str, ...] = VITAL) -> DataFrame:
    """Nodes ``(id, node_type)`` that have an edge or are of a vital type."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kept = nodes.where(F.col("node_type").isin(*vital))
    return nodes.where(~F.coalesce(F.col("node_type").isin(*vital), F.lit(False))).join(ends, "id", "left_semi").unionByName(kept)


def prune_components(nodes: DataFrame, edges: DataFrame, least: int = 3, vital: tuple[str, ...] = VITAL) -> DataFrame:
    """Nodes whose weakly connected component has ``least`` nodes, or a vital one."""
    comp = connected_components(edges).withColumnRenamed("node", "id")
    n = nodes.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    good = n.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("node_type").isin(*vital), F.lit(False))).alias("v")).where(F.col("v") | (F.col("n") >= least))
    return n.join(good, "component", "left_semi").select(*nodes.columns)


def khop(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``(seed, node, hops)`` of what is within ``depth`` edges of each seed, either way, without the seed itself.

    A frontier and what it has seen, joined once for each hop; the plan is cut after each. Every hop reads the
    edges, so give a table of them; repeated ones do no harm. A small frontier goes to them, a large one meets them by node.
    """
    seen = materialise(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct(), "seeds")
    frontier, total = seen, None
    for h in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        two = both_ways(edges)
        if n > FRONTIER:
            total = edges.count() if total is None else total
            two = spread(two, 2 * total, "node")
            step = frontier.join(two, "node")
        else:
            step = two.join(F.broadcast(frontier), "node")
        step = step.select("seed", F.col("other").alias("node")).distinct()
        frontier = materialise(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(h)), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Edges among the seeds and what is within ``depth`` hops of any."""
    near = khop(edges, seeds, depth).select("node").unionByName(seeds.select(F.col("seed").alias("node"))).distinct()
    return with_endpoints(edges, near, "node")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, other, outgoing)``: the edges of each of ``nodes``, seen from it."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"))
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("outgoing"))
    return out.unionByName(back).join(nodes.select("node").distinct(), "node", "left_semi")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``(node, rank)`` after a fixed number of rounds along ``src -> dst``; what has no way out passes nothing on.

    Edges are written by ``dst`` once. In a round what each source passes on goes to them, if sources are few, so
    edges stay where they are and only sums of nodes are moved.
    """
    e = materialise(edges.select("src", "dst"), "edges")
    total = e.count()
    n_tasks = tasks(e.sparkSession, total)
    links = materialise(e.repartition(n_tasks, "dst") if n_tasks else e.repartition("dst"), "links")
    discard(e)
    out = materialise(links.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "out")
    nodes = materialise(links.select(F.col("dst").alias("node")).unionByName(out.select(F.col("src").alias("node"))).distinct(), "nodes")
    n, few = nodes.count(), out.count() <= SOURCES
    rank = nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        gives = out.join(rank.withColumnRenamed("node", "src"), "src").select("src", (F.col("rank") / F.col("out")).alias("gives"))
        met = links.join(F.broadcast(gives), "src") if few else spread(links, total, "src").join(gives, "src")
        passed = met.groupBy(F.col("dst").alias("node")).agg(F.sum("gives").alias("in"))
        last, rank = rank, materialise(nodes.join(passed, "node", "left").select("node", ((1 - damping) / max(1, n) + damping * F.coalesce("in", F.lit(0.0))).alias("rank")), "rank")
        discard(last)
    return rank


def centrality(edges: DataFrame) -> DataFrame:
    """``(node, centrality, z)``: degree over the other nodes, and how many standard deviations it is from the mean."""
    d = degree(edges)
    n = d.agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("dev"))
    # one row of totals
    return d.crossJoin(F.broadcast(n)).select("node", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"), F.when(F.col("dev") > 0, (F.col("degree") - F.col("mean")) / F.col("dev")).otherwise(F.lit(0.0)).alias("z"))


def by_degree(edges: DataFrame, offset: int, count: int) -> DataFrame:
    """A page of nodes by falling degree; ties by id."""
    return degree(edges).orderBy(F.desc("degree"), "node").offset(offset).limit(count)


def rank_in(partition: list[Column], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
