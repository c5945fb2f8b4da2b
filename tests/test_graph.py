import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lexigrid.operators import communities as C
from lexigrid.operators import entities as E
from lexigrid.operators import graph as G
from lexigrid.operators import upsert as U
from lexigrid.operators.components import connected_components


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def as_dict(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in parent}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_contract(spark):
    e = edges(spark, [("a", "x", 0.2), ("b", "x", 0.7), ("a", "b", 1.0), ("c", "c", 0.4), ("y", "c", None), ("b", "z", 0.2), ("c", "z", None)])
    m = spark.createDataFrame([(n, "a") for n in "abc"], "node string, canonical string")
    assert as_dict(G.contract(e, m)) == {("a", "x"): 0.7, ("a", "a"): 0.4, ("y", "a"): None, ("a", "z"): 1.0}


def test_prune(spark):
    e = spark.createDataFrame([("a", "b", "0.005"), ("b", "c", "0.01"), ("c", "d", None), ("d", "e", "x")], "src string, dst string, weight string")
    assert {r["src"] for r in G.prune_edges(e).collect()} == {"b", "c", "d"}
    nodes = spark.createDataFrame([("a", "CHUNK"), ("t", "TOPIC"), ("i", "CHUNK"), ("b", "CHUNK"), ("u", "DAY"), ("v", "CHUNK")], "id string, node_type string")
    link = spark.createDataFrame([("a", "b"), ("u", "v")], "src string, dst string")
    assert {r["id"] for r in G.prune_isolated(nodes, link).collect()} == {"a", "b", "t", "u", "v"}
    assert {r["id"] for r in G.prune_components(nodes, link).collect()} == {"t", "u", "v"}


def test_khop_and_neighbours(spark):
    e = edges(spark, [("a", "b", 1.0), ("c", "b", 1.0), ("c", "d", 1.0), ("d", "d", 1.0)])
    seeds = spark.createDataFrame([("a",), ("d",)], "seed string")
    got = {(r["seed"], r["node"], r["hops"]) for r in G.khop(e, seeds, 2).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("d", "c", 1), ("d", "b", 2)}


def recorded(monkeypatch, module):
    """What ``module`` writes from now on: label, rows and the plan it was made by."""
    seen, write = [], module.materialise

    def run(df, label="t"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, label)
        seen.append((label, out.count(), plan))
        return out

    monkeypatch.setattr(module, "materialise", run)
    return seen


def test_khop_writes_what_it_finds_not_all_edges(spark, monkeypatch):
    e = spark.range(3000).selectExpr("concat('x', id) AS src", "concat('y', id) AS dst").union(edges(spark, [("a", "b", 1.0), ("a", "b", 2.0), ("c", "b", 1.0)]).select("src", "dst"))
    seeds = spark.createDataFrame([("a",)], "seed string")
    written = recorded(monkeypatch, G)
    want = {("a", "b", 1), ("a", "c", 2)}
    assert {tuple(r) for r in G.khop(e, seeds, 2).collect()} == want and max(n for _, n, _ in written) < 10
    monkeypatch.setattr(G, "FRONTIER", 0)  # as if the frontier were large
    assert {tuple(r) for r in G.khop(e, seeds, 2).collect()} == want


def test_edge_profile_moves_ends_of_edges_once(spark):
    from lexigrid.operators.profile import edge_profile

    e = spark.createDataFrame([("a", "x", "R"), ("b", "x", "R"), ("a", "gone", "R"), (None, "x", "S"), ("c", None, "S")], "src string, dst string, rel string")
    n = spark.createDataFrame([("a", "A"), ("b", None), ("x", "X"), ("c", "A")], "id string, node_type string")
    out = edge_profile(e, n)
    assert {r["rel"]: tuple(r)[1:] for r in out.collect()} == {"R": (3, ["A", "UNKNOWN"], ["X"]), "S": (2, ["A"], ["X"])}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_pagerank_leaves_edges_where_they_are(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(20)}", f"n{rng.randrange(30)}") for _ in range(80)]
    nodes = sorted({n for p in pairs for n in p})
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(3):
        into = dict.fromkeys(nodes, 0.0)
        for a, b in pairs:
            into[b] += want[a] / sum(x == a for x, _ in pairs)
        want = {n: 0.15 / len(nodes) + 0.85 * into[n] for n in nodes}
    e = spark.createDataFrame(pairs, "src string, dst string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        written = recorded(monkeypatch, G)
        few = {r["node"]: r["rank"] for r in G.pagerank(e, 3).collect()}
        assert all("BroadcastHashJoin" in plan for label, _, plan in written if label == "rank")
        monkeypatch.setattr(G, "SOURCES", 0)  # as if sources were many
        many = {r["node"]: r["rank"] for r in G.pagerank(e, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for n in nodes:
        assert abs(few[n] - want[n]) < 1e-12 and abs(many[n] - want[n]) < 1e-12


def test_similarity_pairs_over_several_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(50)] + [(99, None)]
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows[:-1], 2) if cos(x, y) >= 0.5}
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    for block in (7, 4096):
        assert {(r["a"], r["b"]) for r in G.similarity_pairs(v, 0.5, block_rows=block).collect()} == want


def test_blocks_meet_in_strips():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4096, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids = pa.array([f"{i:04}" for i in range(len(x))])
    tracemalloc.start()
    n = sum(b.num_rows for b in G._strips(ids, x, ids, x, 0.5, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the product of the blocks takes 134 MB
    assert n == np.count_nonzero(np.triu(x @ x.T >= 0.5, 1))


def quality(pairs, part):
    m = len(pairs)
    deg = {}
    for u, v in pairs:
        deg[u] = deg.get(u, 0) + 1
        deg[v] = deg.get(v, 0) + 1
    inner = sum(part[u] == part[v] for u, v in pairs) / m
    return inner - sum((sum(d for n, d in deg.items() if part[n] == c) / (2 * m)) ** 2 for c in set(part.values()))


def test_louvain_reaches_the_best_partition_of_small_graphs():
    two_cliques = [(a, b) for a, b in itertools.combinations(range(4), 2)] + [(a + 4, b + 4) for a, b in itertools.combinations(range(4), 2)] + [(3, 4)]
    part = C.louvain([(u, v, 1.0) for u, v in two_cliques])
    best = max(quality(two_cliques, dict(enumerate(p))) for p in itertools.product(range(3), repeat=8))
    assert abs(quality(two_cliques, part) - best) < 1e-9


def test_merge_small():
    part = {"a": 0, "b": 0, "c": 1, "d": 2, "e": 2}
    assert C.merge_small(part, [("c", "d"), ("c", "e"), ("c", "a")])["c"] == 2
    assert C.merge_small(part, [("a", "b")])["c"] == 0


def test_large_components_go_to_label_propagation(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0)])
    got = {r["node"]: r["community"] for r in C.communities(e, local_edges=2).collect()}
    assert set(got) == {"a", "b", "c", "x", "y"} and got["x"] == got["y"] == "x"


def test_coref():
    got = E.greedy_names(["ECB", "ecb.", "President of ECB", "ECB of President", "Other"])
    assert got["ecb."] == got["ECB"] == "ecb."  # the longer spelling is shown
    assert got["President of ECB"] == got["ECB of President"] and got["Other"] == "Other"


def test_few_pairs_of_names_are_matched(monkeypatch):
    built, calls = [], []

    class Counting(E.SequenceMatcher):
        def __init__(self, *a, **k):
            built.append(1)
            super().__init__(*a, **k)

        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(E, "SequenceMatcher", Counting)
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(12)) for _ in range(150)} | {"alpha beta", "alpha betas", "beta alpha"})
    got = E.greedy_names(names)
    assert len(built) <= len(names) and len(calls) < 500  # a pair each before: over 11,000
    assert got["alpha beta"] == got["alpha betas"] == "alpha betas" and got["beta alpha"] == "beta alpha"
    shuffled = " ".join("abcdefghij"), " ".join("jihgfedcba"), " ".join("abcdefghijk")
    assert len(set(E.greedy_names(sorted(shuffled)).values())) == 1  # 10 words of 11, by words alone


def test_triples_of_text_are_those_of_the_two_steps(spark):
    c = spark.createDataFrame([("d", "Ada Lovelace met Charles Babbage. Then Mr. Babbage left U.S. Then Ada Byron wrote."), ("e", None), ("f", "none here")], "doc_id string, text string")
    two = E.extract_triples(E.ner_spans(c)).selectExpr("doc_id", "inline(triples)")
    assert E.triples_of(c).collect() == two.collect() != []


def test_remap_drops_self_loops_and_blanks(spark):
    t = spark.createDataFrame([(1, "A", "r", "a."), (1, "A", "r", "B"), (1, "a.", "r", "B"), (1, " ", "r", "B")], "s int, h string, r string, t string")
    m = spark.createDataFrame([(1, "A", "a."), (1, "a.", "a.")], "s int, name string, mapped string")
    assert [tuple(r) for r in E.remap(t, m, ["s"]).collect()] == [(1, "a.", "r", "B")]


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", 2)], "id string, p string, q int")
    new = spark.createDataFrame([("a", None, 1, "n"), ("c", "z", None, None)], "id string, p string, q int, more string")
    got = {r["id"]: tuple(r)[1:] for r in U.merge_nodes(old, new, "id").collect()}
    assert got == {"a": ("x", 1, "n"), "b": ("y", 2, None), "c": ("z", None, None)}
    e = spark.createDataFrame([("a", "r", "b", 1.0), ("a", "r", "gone", 1.0)], "src string, rel string, dst string, weight double")
    merged = U.merge_edges(e.limit(0), e, new.select("id").unionByName(old.select("id")).distinct())
    assert [(r["src"], r["dst"]) for r in merged.collect()] == [("a", "b")]


def test_models_that_fail_leave_chunks_empty(spark):
    def broken():
        def run(*_):
            raise RuntimeError("down")

        return run

    c = spark.createDataFrame([("c", "Some Text here.")], "chunk_id string, text string")
    out = E.extract_triples(E.ner_spans(c, broken), broken).first()
    assert out["spans"] == [] and out["triples"] == [] and out["extraction_successful"] is False
