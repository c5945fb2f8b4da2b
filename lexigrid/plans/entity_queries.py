"""Entities and relations from chunks, and their resolution by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import entities as E
from lexigrid.operators import graph as G
from lexigrid.operators.embed import embed
from lexigrid.plans.base import CHUNKS, DOCS, chunks, documents, table
from lexigrid.plans.registry import query
from lexigrid.storage import materialise

#: Names with spellings: the part's name, in capitals where its size is odd.
NAMES = "names AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_size % 2 = 1 THEN upper(p_name) ELSE p_name END AS name FROM part)"
#: Triples: supplier country, part name.
TRIPLES = f"{NAMES}, triples AS (SELECT DISTINCT p.p_brand AS h, l.l_returnflag AS r, p.name AS t FROM lineitem l JOIN names p ON l.l_partkey = p.p_partkey)"


def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.when(F.col("p_size") % 2 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))


@query("ner_spans")
def ner_spans(spark, d):
    """Through the built-in surrogate model."""
    return E.ner_spans(chunks(spark, d)).select("chunk_id", F.transform("spans", lambda s: F.concat_ws("|", s["text"], s["label"])).alias("spans"))


@query("extract_triples")
def extract_triples(spark, d):
    t = E.extract_triples(E.ner_spans(chunks(spark, d)))
    return t.select("chunk_id", "extraction_successful", F.explode_outer("triples").alias("x")).select("chunk_id", "extraction_successful", "x.h", "x.r", "x.t")


@query("string_similarity")
def string_similarity(spark, d):
    n = table(spark, d, "part").select("p_name").distinct()
    pairs = n.alias("x").join(n.alias("y"), F.col("x.p_name") < F.col("y.p_name"))
    return pairs.select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b")).withColumn("ratio", E.string_similarity(F.col("a"), F.col("b")))


@query("coref_greedy")
def coref_greedy(spark, d):
    return E.coref(_names(spark, d).select(F.col("p_brand").alias("scope_id"), "name"))


@query("enrich_scope")
def enrich_scope(spark, d):
    """Triples of each document after its names are resolved."""
    t = materialise(E.triples_of(chunks(spark, d)), "triples")
    names = t.select("doc_id", F.explode(F.array("h", "t")).alias("name"))
    return E.remap(t, E.coref(names, "doc_id"), ["doc_id"])


@query("embed_nodes")
def embed_nodes(spark, d):
    e = embed(chunks(spark, d).select("chunk_id", "text"), F.col("text"), keep=["chunk_id"])
    return e.select("chunk_id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query("display_name", f"WITH {NAMES} SELECT canonical, display FROM (SELECT lower(name) AS canonical, name AS display, row_number() OVER (PARTITION BY lower(name) ORDER BY length(name) DESC, length(regexp_replace(name, '[^A-Z]', '', 'g')) DESC, name DESC) AS k FROM names) WHERE k = 1")
def display_name(spark, d):
    return E.display_name(_names(spark, d).withColumn("canonical", F.lower("name")), "canonical", "name")


@query("ner_label_map", f"WITH {NAMES}, f AS (SELECT name, p_brand, p_partkey FROM names UNION SELECT lower(name), p_brand, p_partkey FROM names) SELECT name, arg_max(p_brand, p_partkey) AS label FROM f GROUP BY name")
def ner_label_map(spark, d):
    return E.label_map(_names(spark, d).select(F.col("name").alias("text"), F.col("p_brand").alias("label"), "p_partkey"), ["p_partkey"])


@query(
    "entity_build",
    f"""WITH {NAMES}, n AS (SELECT name, min(p_type) AS llm_type FROM names GROUP BY name), l AS (SELECT name, arg_max(p_brand, p_partkey) AS label FROM names WHERE p_size > 25 GROUP BY name),
low AS (SELECT name, arg_max(p_brand, p_partkey) AS label FROM (SELECT name, p_brand, p_partkey FROM names WHERE p_size > 25 UNION SELECT lower(name), p_brand, p_partkey FROM names WHERE p_size > 25) GROUP BY name)
SELECT n.name, coalesce(a.label, b.label, 'Concept') AS ontology_class, llm_type FROM n LEFT JOIN low a ON n.name = a.name LEFT JOIN low b ON lower(n.name) = b.name""",
)
def entity_build(spark, d):
    n = _names(spark, d)
    labels = E.label_map(n.where("p_size > 25").select(F.col("name").alias("text"), F.col("p_brand").alias("label"), "p_partkey"), ["p_partkey"])
    return E.build(n.select("name", F.col("p_type").alias("llm_type")), labels)


def _triples(spark, d):
    n = _names(spark, d)
    return table(spark, d, "lineitem").join(n, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("h"), F.col("l_returnflag").alias("r"), F.col("name").alias("t"))


@query("remap_join", f"WITH {TRIPLES} SELECT h, r, lower(t) AS t FROM triples GROUP BY ALL")
def remap_join(spark, d):
    mapping = _names(spark, d).select("name", F.lower("name").alias("mapped")).distinct()
    return E.remap(_triples(spark, d), mapping, [])


@query("dedup_triples", f"WITH {TRIPLES} SELECT h, r, t FROM triples WHERE h <> t")
def dedup_triples(spark, d):
    nothing = spark.createDataFrame([], "name string, mapped string")
    return E.remap(_triples(spark, d), nothing, [])


@query("relation_edges", f"WITH {TRIPLES} SELECT h AS src, t AS dst, r AS rel, 'extraction' AS source FROM triples WHERE h IN (SELECT p_brand FROM part WHERE p_size > 10) AND t IN (SELECT p_name FROM part)")
def relation_edges(spark, d):
    p = table(spark, d, "part")
    nodes = p.where("p_size > 10").select(F.col("p_brand").alias("id")).unionByName(p.select(F.col("p_name").alias("id"))).distinct()
    t = _triples(spark, d).distinct().select(F.col("h").alias("src"), F.col("t").alias("dst"), F.col("r").alias("rel"), F.lit("extraction").alias("source"))
    return G.with_endpoints(t, nodes)


@query("mention_edges", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS chunk_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey")
def mention_edges(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = t.groupBy(F.col("l_orderkey").cast("string").alias("chunk_id")).agg(F.collect_list(F.struct(F.col("p_name").alias("h"), F.col("l_returnflag").alias("r"), F.col("p_name").alias("t"))).alias("triples"))
    return E.mentions(c.withColumn("entities", F.array().cast("array<string>")))


@query("union_surface_forms", f"WITH {TRIPLES} SELECT h AS name FROM triples UNION SELECT t FROM triples UNION SELECT p_type FROM part")
def union_surface_forms(spark, d):
    t = _triples(spark, d)
    return t.select(F.col("h").alias("name")).union(t.select("t")).union(table(spark, d, "part").select("p_type")).distinct()


@query("allowed_nodes", f"WITH {NAMES} SELECT p_partkey, list_sort(list_distinct([name, p_brand, p_type, lower(name)])) AS allowed FROM names")
def allowed_nodes(spark, d):
    n = _names(spark, d)
    return n.select("p_partkey", F.sort_array(F.array_union(F.array("name", "p_brand"), F.array("p_type", F.lower("name")))).alias("allowed"))


@query("dedup_tasks", "SELECT o_custkey AS chunk_id, min(o_orderkey) AS task FROM orders GROUP BY o_custkey")
def dedup_tasks(spark, d):
    """The first task of each chunk."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("chunk_id")).agg(F.min("o_orderkey").alias("task"))


@query("extraction_stats", "WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS processed, count(*) FILTER (WHERE n > 1) AS successful, sum(n) AS entities FROM c")
def extraction_stats(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n"))
    return c.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("n") > 1).alias("successful"), F.sum("n").alias("entities"))


@query("type_counts", "SELECT label AS type, count(*) AS n FROM embeddings GROUP BY label")
def type_counts(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("lexical_graph", f"WITH {DOCS}, {CHUNKS} SELECT doc_id AS src, chunk_id AS dst, 'CONTAINS' AS rel, 'DOCUMENT' AS src_label, 'CHUNK' AS dst_label FROM docs JOIN chunks USING (doc_id)")
def lexical_graph(spark, d):
    from lexigrid.engine import lexical_edges

    return lexical_edges(documents(spark, d), chunks(spark, d))


@query("scope_chunks", f"WITH {DOCS}, {CHUNKS} SELECT chunk_id, position FROM chunks JOIN docs USING (doc_id) WHERE doc_id = '7'")
def scope_chunks(spark, d):
    from lexigrid.engine import lexical_edges

    e = lexical_edges(documents(spark, d), chunks(spark, d)).where("src = '7'").select(F.col("dst").alias("chunk_id"))
    return chunks(spark, d).join(e, "chunk_id", "left_semi").select("chunk_id", "position")
