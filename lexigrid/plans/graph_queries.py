"""Graph operators: joins, resolution, communities, pruning, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import vectors as V
from lexigrid.operators import communities as C
from lexigrid.operators import graph as G
from lexigrid.operators import topics as TP
from lexigrid.plans.base import CHUNKS, ENTITIES, RELATIONS, SIMILAR, chunks, entities, links, relations, table
from lexigrid.plans.registry import query
from lexigrid.storage import materialise

PAIRS = ENTITIES + f""",
pairs AS (SELECT x.entity_id AS a, y.entity_id AS b, {V.sql_cosine('x.embedding', 'y.embedding')} AS similarity
  FROM entities x JOIN entities y ON x.entity_id < y.entity_id WHERE {V.sql_cosine('x.embedding', 'y.embedding')} >= {SIMILAR})"""
COMPONENTS = PAIRS + """,
ends AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(n, r) AS (SELECT u, u FROM ends UNION SELECT reach.n, ends.v FROM reach JOIN ends ON reach.r = ends.u),
comp AS (SELECT n AS node, min(r) AS component FROM reach GROUP BY n)"""
CANONICAL = COMPONENTS + """,
deg AS (SELECT u AS node, count(*) AS degree FROM ends GROUP BY u),
picked AS (SELECT c.node, first_value(c.node) OVER (PARTITION BY c.component ORDER BY d.degree DESC, length(c.node) DESC, c.node) AS canonical FROM comp c JOIN deg d ON c.node = d.node)"""
#: Edges among entities, a ring in the order of ids, to be rewired by what is merged.
RING = "ring AS (SELECT 'e' || CAST(vec_id AS VARCHAR) AS src, 'e' || CAST((vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS VARCHAR) AS dst, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE (vec_id % 10) / 10.0 END AS weight, label % 3 AS kind FROM embeddings)"


def _pairs(spark, d):
    return G.similarity_pairs(entities(spark, d), SIMILAR, "entity_id")


def _components(spark, d):
    return G.clusters(_pairs(spark, d))


def _picked(spark, d):
    p = materialise(_pairs(spark, d), "pairs")
    deg = G.degree(p.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = G.clusters(p).withColumn("name", F.col("node"))
    return G.pick_canonical(members, deg)


def _ring(spark, d):
    t = table(spark, d, "embeddings")
    n = t.count()
    e = lambda c: F.concat(F.lit("e"), c.cast("string"))
    return t.select(e(F.col("vec_id")).alias("src"), e((F.col("vec_id") * 7 + 3) % n).alias("dst"), F.when(F.col("vec_id") % 5 != 0, (F.col("vec_id") % 10) / 10.0).alias("weight"), (F.col("label") % 3).alias("kind"))


@query("similarity_self_join", f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def similarity_self_join(spark, d):
    return _pairs(spark, d).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("semantic_clusters", f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM comp")
def semantic_clusters(spark, d):
    return _components(spark, d)


@query("canonical_pick", f"WITH RECURSIVE {CANONICAL} SELECT node, canonical FROM picked")
def canonical_pick(spark, d):
    return _picked(spark, d)


_CONTRACTED = f"""WITH RECURSIVE {CANONICAL}, {RING},
e AS (SELECT coalesce(x.canonical, r.src) AS s, coalesce(y.canonical, r.dst) AS t, r.* FROM ring r LEFT JOIN picked x ON r.src = x.node LEFT JOIN picked y ON r.dst = y.node),
k AS (SELECT * FROM e WHERE s <> t OR src = dst)"""


@query(
    "merge_nodes_into",
    _CONTRACTED
    + """ SELECT s AS src, t AS dst, CASE WHEN count(*) > 1 THEN max(coalesce(weight, 1.0)) ELSE max(weight) END AS weight,
arg_min(kind, row((src <> s OR dst <> t), src, dst, kind)) AS kind FROM k GROUP BY s, t""",
)
def merge_nodes_into(spark, d):
    return G.contract(_ring(spark, d), materialise(_picked(spark, d), "picked"))


@query(
    "resolve_semantic",
    f"WITH RECURSIVE {CANONICAL} SELECT (SELECT count(*) FROM picked WHERE node <> canonical) AS merged_nodes, (SELECT count(DISTINCT component) FROM comp) AS clusters_found, (SELECT count(*) FROM pairs) AS high_similarity_pairs",
)
def resolve_semantic(spark, d):
    pairs = materialise(_pairs(spark, d), "pairs")
    deg = G.degree(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    comp = materialise(G.clusters(pairs), "clusters")
    picked = G.pick_canonical(comp.withColumn("name", F.col("node")), deg)
    merged = picked.where("node <> canonical").agg(F.count(F.lit(1)).alias("merged_nodes"))
    return merged.crossJoin(comp.agg(F.countDistinct("component").alias("clusters_found"))).crossJoin(pairs.agg(F.count(F.lit(1)).alias("high_similarity_pairs")))


@query(
    "alias_union",
    f"WITH RECURSIVE {CANONICAL} SELECT p.canonical, list_sort(list_distinct(flatten(list([ 'type ' || e.type, p.node])))) AS aliases FROM picked p JOIN entities e ON p.node = e.entity_id WHERE p.node <> p.canonical GROUP BY p.canonical",
)
def alias_union(spark, d):
    nodes = entities(spark, d).select(F.col("entity_id").alias("id"), F.lit(None).cast("string").alias("name"), F.array(F.concat(F.lit("type "), F.col("type"))).alias("aliases"))
    return G.merge_aliases(nodes, materialise(_picked(spark, d), "picked"))


@query("degree", f"WITH {RELATIONS} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM relations UNION ALL SELECT dst FROM relations) GROUP BY node")
def degree(spark, d):
    return G.degree(relations(spark, d))


@query("prune_edges", f"WITH {RELATIONS} SELECT src, dst, round(weight, 9) AS weight FROM relations WHERE weight IS NULL OR weight >= 0.01")
def prune_edges(spark, d):
    return G.prune_edges(relations(spark, d)).select("src", "dst", F.round("weight", 9).alias("weight"))


_NODES = ENTITIES + ", nodes AS (SELECT entity_id AS id, CASE WHEN vec_id % 50 = 0 THEN 'TOPIC' ELSE 'ENTITY' END AS node_type FROM entities)"


def _nodes(spark, d):
    return entities(spark, d).select(F.col("entity_id").alias("id"), F.when(F.col("vec_id") % 50 == 0, F.lit("TOPIC")).otherwise(F.lit("ENTITY")).alias("node_type"))


def _pair_edges(spark, d):
    return materialise(_pairs(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")), "pairs")


@query(
    "prune_isolated",
    f"WITH {PAIRS}, nodes AS (SELECT entity_id AS id, CASE WHEN vec_id % 50 = 0 THEN 'TOPIC' ELSE 'ENTITY' END AS node_type FROM entities) SELECT id, node_type FROM nodes WHERE node_type = 'TOPIC' OR id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)",
)
def prune_isolated(spark, d):
    return G.prune_isolated(_nodes(spark, d), _pair_edges(spark, d))


@query(
    "prune_components",
    f"""WITH RECURSIVE {COMPONENTS}, nodes AS (SELECT entity_id AS id, CASE WHEN vec_id % 50 = 0 THEN 'TOPIC' ELSE 'ENTITY' END AS node_type, coalesce(c.component, entity_id) AS c FROM entities LEFT JOIN comp c ON c.node = entity_id),
good AS (SELECT c FROM nodes GROUP BY c HAVING count(*) >= 3 OR max(CASE WHEN node_type = 'TOPIC' THEN 1 ELSE 0 END) = 1)
SELECT id, node_type FROM nodes WHERE c IN (SELECT c FROM good)""",
)
def prune_components(spark, d):
    return G.prune_components(_nodes(spark, d), _pair_edges(spark, d))


TWO = "two AS (SELECT DISTINCT src AS node, dst AS other FROM relations UNION SELECT dst, src FROM relations)"


@query(
    "khop",
    f"""WITH {RELATIONS}, {TWO}, h1 AS (SELECT DISTINCT other AS node FROM two WHERE node = 's1'),
h2 AS (SELECT DISTINCT other AS node FROM two JOIN h1 ON two.node = h1.node WHERE other <> 's1' AND other NOT IN (SELECT node FROM h1))
SELECT 's1' AS seed, node, 1 AS hops FROM h1 UNION ALL SELECT 's1', node, 2 FROM h2""",
)
def khop(spark, d):
    seeds = spark.createDataFrame([("s1",)], "seed string")
    return G.khop(links(spark, d), seeds, 2)


@query(
    "graph_expand",
    f"""WITH {RELATIONS}, {TWO}, h1 AS (SELECT 's1' AS node UNION SELECT other FROM two WHERE node = 's1')
SELECT src, dst, round(weight, 9) AS weight FROM relations WHERE src IN (SELECT node FROM h1) AND dst IN (SELECT node FROM h1)""",
)
def graph_expand(spark, d):
    seeds = spark.createDataFrame([("s1",)], "seed string")
    return G.expand(materialise(relations(spark, d), "relations"), seeds, 1).select("src", "dst", F.round("weight", 9).alias("weight"))


_NEIGHBOURS = f"WITH {RELATIONS} SELECT src AS node, dst AS other, true AS outgoing FROM relations WHERE src = 's1' UNION ALL SELECT dst, src, false FROM relations WHERE dst = 's1'"


@query("node_neighbours", _NEIGHBOURS)
def node_neighbours(spark, d):
    return G.neighbours(relations(spark, d), spark.createDataFrame([("s1",)], "node string"))


@query("one_hop", f"WITH {RELATIONS} SELECT src AS node, dst AS other FROM relations UNION ALL SELECT dst, src FROM relations")
def one_hop(spark, d):
    return G.both_ways(relations(spark, d))


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {RELATIONS}, nodes AS (SELECT src AS node FROM relations UNION SELECT dst FROM relations), n AS (SELECT count(*) AS n FROM nodes), links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM relations), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)"
    for i in range(rounds):
        out += f", r{i + 1} AS (SELECT x.node, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(y.s, 0) AS rank FROM nodes x CROSS JOIN n LEFT JOIN (SELECT l.dst AS node, sum(r.rank / l.o) AS s FROM links l JOIN r{i} r ON l.src = r.node GROUP BY l.dst) y ON x.node = y.node)"
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _pagerank_sql(5))
def pagerank(spark, d):
    return G.pagerank(relations(spark, d), 5).select("node", F.round("rank", 9).alias("rank"))


@query(
    "degree_centrality_z",
    f"""WITH {RELATIONS}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM relations UNION ALL SELECT dst FROM relations) GROUP BY node)
SELECT node, round(degree / ((SELECT count(*) FROM g) - 1), 9) AS centrality, round((degree - (SELECT avg(degree) FROM g)) / (SELECT stddev_pop(degree) FROM g), 6) AS z FROM g""",
)
def degree_centrality_z(spark, d):
    return G.centrality(materialise(relations(spark, d), "relations")).select("node", F.round("centrality", 9).alias("centrality"), F.round("z", 6).alias("z"))


_DEGREES = f"WITH {RELATIONS}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM relations UNION ALL SELECT dst FROM relations) GROUP BY node)"


@query("top_degree_nodes", _DEGREES + " SELECT node, degree FROM g ORDER BY degree DESC, node LIMIT 100 OFFSET 100")
def top_degree_nodes(spark, d):
    """The second page of a hundred."""
    return G.by_degree(relations(spark, d), 100, 100)


@query("communities_degree_bins", _DEGREES + " SELECT node, least(CAST(trunc(degree / ((SELECT max(degree) FROM g) / 4)) AS INTEGER), 3) AS community FROM g")
def communities_degree_bins(spark, d):
    return C.degree_bins(relations(spark, d))


@query("communities_leiden")
def communities_leiden(spark, d):
    """Modularity optimisation by component; the tests hold it against exhaustive search on small graphs."""
    return C.communities(_pair_edges(spark, d))


def _lpa_sql(rounds: int) -> str:
    out = f"WITH {PAIRS}, two AS (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs), l0 AS (SELECT DISTINCT node, node AS community FROM two)"
    for i in range(rounds):
        out += f", l{i + 1} AS (SELECT node, community FROM (SELECT node, community, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS k FROM (SELECT two.node, l.community, count(*) AS n FROM two JOIN l{i} l ON two.other = l.node GROUP BY ALL)) WHERE k = 1)"
    return out + f" SELECT node, community FROM l{rounds}"


@query("communities_lpa", _lpa_sql(3))
def communities_lpa(spark, d):
    return C.label_propagation(_pair_edges(spark, d), 3)


#: Assignment by label, a fixture that SQL has too.
ASSIGNED = "assigned AS (SELECT entity_id AS node, type AS community FROM entities)"


def _assigned(spark, d):
    return entities(spark, d).select(F.col("entity_id").alias("node"), F.col("type").alias("community"))


@query(
    "modularity",
    f"""WITH {ENTITIES}, {RING}, {ASSIGNED}, e AS (SELECT coalesce(weight, 1.0)::DOUBLE AS w, x.community AS cs, y.community AS cd FROM ring JOIN assigned x ON src = x.node JOIN assigned y ON dst = y.node),
m AS (SELECT sum(w) AS m FROM e), o AS (SELECT cs AS c, sum(w) AS o FROM e GROUP BY cs), i AS (SELECT cd AS c, sum(w) AS i FROM e GROUP BY cd)
SELECT round((SELECT sum(w) FROM e WHERE cs = cd) / m - (SELECT sum(o.o * i.i) FROM o JOIN i ON o.c = i.c) / (m * m), 9) AS modularity FROM m""",
)
def modularity(spark, d):
    return C.modularity(_ring(spark, d), _assigned(spark, d)).select(F.round("modularity", 9).alias("modularity"))


@query(
    "community_stats",
    f"WITH {ENTITIES}, {ASSIGNED}, s AS (SELECT community, count(*) AS n FROM assigned GROUP BY community) SELECT count(*) AS communities, min(n) AS smallest, max(n) AS largest, avg(n) AS mean FROM s",
)
def community_stats(spark, d):
    s = _assigned(spark, d).groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("communities"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


@query(
    "local_renumber",
    f"WITH {ENTITIES}, {ASSIGNED} SELECT node, dense_rank() OVER (ORDER BY least) - 1 AS community_id FROM (SELECT node, min(node) OVER (PARTITION BY community) AS least FROM assigned)",
)
def local_renumber(spark, d):
    return C.local_numbers(_assigned(spark, d))


@query(
    "merge_small_comms",
    f"""WITH {ENTITIES}, {RING}, assigned AS (SELECT entity_id AS node, vec_id // 3 AS community FROM entities), size AS (SELECT community, count(*) AS n FROM assigned GROUP BY 1),
v AS (SELECT x.community, y.community AS target, count(*) AS n FROM ring JOIN assigned x ON src = x.node JOIN assigned y ON dst = y.node JOIN size s ON s.community = x.community WHERE s.n < 4 AND x.community <> y.community GROUP BY ALL)
SELECT community, target FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, target) AS k FROM v) WHERE k = 1""",
)
def merge_small_comms(spark, d):
    a = entities(spark, d).select(F.col("entity_id").alias("node"), F.expr("vec_id DIV 3").alias("community"))
    return C.boundary_target(_ring(spark, d), a, 4)


@query("subcommunities")
def subcommunities(spark, d):
    """Second level by label communities over similarity; the tests hold it against exhaustive search on small graphs."""
    return C.sub_communities(_pair_edges(spark, d), _assigned(spark, d))


#: Topics: region over nation over customer. A customer of a nation numbered 24 hangs on the topic itself.
HIERARCHY = """assigned AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS entity_id, n_regionkey AS community_id, CASE WHEN c_nationkey <> 24 THEN c_nationkey END AS sub_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
rows AS (SELECT entity_id, 'TOPIC_' || CAST(community_id AS VARCHAR) AS topic, CASE WHEN sub_id IS NOT NULL THEN 'SUBTOPIC_' || CAST(community_id AS VARCHAR) || '_' || CAST(sub_id AS VARCHAR) END AS sub FROM assigned),
tedges AS (SELECT entity_id AS src, coalesce(sub, topic) AS dst, 'IN_TOPIC' AS rel FROM rows UNION ALL SELECT DISTINCT sub, topic, 'PARENT_TOPIC' FROM rows WHERE sub IS NOT NULL),
members AS (SELECT DISTINCT topic, entity_id FROM (SELECT dst AS topic, src AS entity_id FROM tedges WHERE rel = 'IN_TOPIC' UNION ALL SELECT p.dst, e.src FROM tedges e JOIN tedges p ON e.dst = p.src WHERE p.rel = 'PARENT_TOPIC'))"""


def _hierarchy(spark, d):
    a = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    return TP.topic_hierarchy(a.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("n_regionkey").alias("community_id"), F.when(F.col("c_nationkey") != 24, F.col("c_nationkey")).alias("sub_id")))


@query("topic_hierarchy", f"WITH {HIERARCHY} SELECT src, dst, rel FROM tedges")
def topic_hierarchy(spark, d):
    return _hierarchy(spark, d)[1]


@query("topic_entities", f"WITH {HIERARCHY} SELECT topic, entity_id FROM members")
def topic_entities(spark, d):
    return TP.topic_entities(_hierarchy(spark, d)[1])


@query("parse_topic_id", f"WITH {HIERARCHY} SELECT DISTINCT topic AS id, CAST(string_split(topic, '_')[2] AS INTEGER) AS community_id, CAST(string_split(topic, '_')[3] AS INTEGER) AS sub_id FROM members")
def parse_topic_id(spark, d):
    nodes = _hierarchy(spark, d)[0].select("id")
    c, s = TP.parse_topic_id(F.col("id"))
    return nodes.select("id", c.alias("community_id"), s.alias("sub_id"))


@query("titled_topics", f"WITH {HIERARCHY} SELECT DISTINCT topic AS id FROM members WHERE topic LIKE 'TOPIC\\_%' ESCAPE '\\'")
def titled_topics(spark, d):
    return _hierarchy(spark, d)[0].where(F.startswith("id", F.lit("TOPIC_"))).select("id")


@query(
    "topics_plugin",
    f"WITH {ENTITIES}, {ASSIGNED} SELECT node AS entity_id, CAST(dense_rank() OVER (ORDER BY least) - 1 AS VARCHAR) AS community_id FROM (SELECT node, min(node) OVER (PARTITION BY community) AS least FROM assigned)",
)
def topics_plugin(spark, d):
    from lexigrid.plugins import get_plugin

    out = get_plugin("topics")({"entities": entities(spark, d), "assigned": _assigned(spark, d)})
    return out["entities"].select("entity_id", "community_id")


_TASKS = HIERARCHY + """,
mentions AS (SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, 'c' || CAST(o_custkey AS VARCHAR) AS entity_id FROM orders),
texts AS (SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS position, o_orderpriority AS text FROM orders),
linked AS (SELECT DISTINCT m.topic, t.chunk_id, t.doc_id, t.position, t.text FROM members m JOIN mentions x ON m.entity_id = x.entity_id JOIN texts t ON t.chunk_id = x.chunk_id)"""


def _tasks(spark, d, fallback=0):
    o = table(spark, d, "orders")
    mentions = o.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_id"))
    texts = o.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("text"))
    return TP.topic_tasks(materialise(TP.topic_entities(_hierarchy(spark, d)[1]), "members"), mentions, texts, fallback)


def _tasks_sql(which: str, rest: str = "") -> str:
    return f"""WITH {_TASKS}, listed AS (SELECT topic, string_agg(text, ' ' ORDER BY doc_id, position, chunk_id) AS concatenated_text, list(chunk_id ORDER BY doc_id, position, chunk_id) AS chunk_ids FROM linked WHERE {which} GROUP BY topic),
ents AS (SELECT topic, list_sort(list(entity_id)) AS entity_ids FROM members GROUP BY topic) {rest or "SELECT l.topic AS task_id, concatenated_text, chunk_ids, entity_ids FROM listed l JOIN ents e ON l.topic = e.topic"}"""


@query("topic_tasks", _tasks_sql("topic LIKE 'TOPIC%'"))
def topic_tasks(spark, d):
    return _tasks(spark, d, 10).where(F.startswith("task_id", F.lit("TOPIC_")))


@query("subtopic_tasks", _tasks_sql("topic LIKE 'SUBTOPIC%'"))
def subtopic_tasks(spark, d):
    return _tasks(spark, d).where(F.startswith("task_id", F.lit("SUBTOPIC_")))


@query("entity_chunks", f"WITH {_TASKS} SELECT DISTINCT topic, chunk_id FROM linked")
def entity_chunks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_id"))
    return TP.topic_entities(_hierarchy(spark, d)[1]).join(o, "entity_id").select("topic", "chunk_id").distinct()


@query("summarize_tasks")
def summarize_tasks(spark, d):
    """Through the built-in surrogate model."""
    return TP.summarise(_tasks(spark, d)).select("task_id", "title", "summary")


@query("generate_summaries")
def generate_summaries(spark, d):
    s = TP.summarise(_tasks(spark, d))
    return TP.apply_summaries(_hierarchy(spark, d)[0], s).select("id", "title", "summary", "has_summary")


@query("count_task_status", f"WITH {HIERARCHY}, t AS (SELECT DISTINCT topic FROM members) SELECT count(*) FILTER (WHERE topic LIKE 'T%') AS completed, count(*) FILTER (WHERE topic NOT LIKE 'T%') AS failed FROM t")
def count_task_status(spark, d):
    done = F.startswith("id", F.lit("TOPIC_"))
    return _hierarchy(spark, d)[0].agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"))


@query(
    "apply_summaries",
    f"WITH {HIERARCHY}, t AS (SELECT DISTINCT topic AS id, topic LIKE 'SUB%' AS sub FROM members) SELECT id, CASE WHEN sub THEN 'old' ELSE 'title of ' || id END AS title, CASE WHEN sub THEN NULL ELSE 'about ' || id END AS summary, NOT sub AS has_summary FROM t",
)
def apply_summaries(spark, d):
    nodes = _hierarchy(spark, d)[0].withColumn("title", F.lit("old"))
    s = nodes.where("node_type = 'TOPIC'").select(F.col("id").alias("task_id"), F.concat(F.lit("title of "), "id").alias("title"), F.concat(F.lit("about "), "id").alias("summary"), F.array().cast("array<string>").alias("chunk_ids"), F.array().cast("array<string>").alias("entity_ids"))
    return TP.apply_summaries(nodes, s).select("id", "title", "summary", "has_summary")


@query("first_n_fallback", f"WITH {CHUNKS} SELECT chunk_id, text FROM chunks ORDER BY doc_id, position LIMIT 10")
def first_n_fallback(spark, d):
    return chunks(spark, d).orderBy("doc_id", "position").limit(10).select("chunk_id", "text")


@query("entity_subgraph", f"WITH {RELATIONS} SELECT src, dst FROM relations WHERE src IN (SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) AND dst IN (SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10 UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)")
def entity_subgraph(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    p = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return G.with_endpoints(relations(spark, d), s.unionByName(p)).select("src", "dst")


@query("filter_edge_type", f"WITH {RELATIONS} SELECT src, dst FROM relations WHERE weight > 0.0512 AND src IN (SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 10)")
def filter_edge_type(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"))
    return relations(spark, d).where("weight > 0.0512").join(s, "src", "left_semi").select("src", "dst")


@query("edge_endpoints", f"WITH {RELATIONS}, n AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 2 = 0) SELECT src, dst FROM relations WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def edge_endpoints(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    p = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return G.with_endpoints(relations(spark, d), s.unionByName(p)).select("src", "dst")
