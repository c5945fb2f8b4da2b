"""The engine: files to a stored knowledge graph, and questions to cited passages.

A graph is a folder of Parquet tables (``sources.graph_store``). Every step is a
DataFrame plan; between steps tables are written, so plans stay short and a lost
executor repeats little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.operators import communities as C
from lexigrid.operators import entities as E
from lexigrid.operators import graph as G
from lexigrid.operators import profile as P
from lexigrid.operators import retrieval as R
from lexigrid.operators import topics as T
from lexigrid.operators import upsert as U
from lexigrid.operators.embed import embed, embedding_text, hashed_trigrams
from lexigrid.sources import files, graph_store
from lexigrid.storage import materialise, shared_dir


def lexical_edges(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """CONTAINS edges from documents to their chunks; a chunk without a document has none."""
    e = chunks.join(documents.select("doc_id"), "doc_id", "left_semi")
    return e.select(F.col("doc_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("CONTAINS").alias("rel"), F.lit("DOCUMENT").alias("src_label"), F.lit("CHUNK").alias("dst_label"))


class Running(RuntimeError):
    """Another run holds the folder."""


@dataclass
class Engine:
    spark: SparkSession
    folder: str
    config: EngineConfig = field(default_factory=EngineConfig)

    # ---- ingestion -------------------------------------------------------------------

    def run(self, input_dir: str, clean_database: bool = False, skip_communities: bool = False) -> dict[str, int]:
        """Ingest the files of a folder and rebuild what depends on them. Only one run at a time may hold the graph."""
        lock = self._lock()
        try:
            if clean_database:
                graph_store.clean(self.spark, self.folder)
            docs, chunks = files.ingest(files.scan_dir(self.spark, input_dir), self.config.chunk_size, self.config.chunk_overlap)
            self.ingest(docs, chunks)
            self.enrich(skip_communities)
            return {r["name"]: r["n"] for r in self.analytics().selectExpr("stack(4, 'documents', documents, 'chunks', chunks, 'entities', entities, 'relationships', relationships) AS (name, n)").collect()}
        finally:
            lock()

    def upload(self, path: str, title: str | None = None) -> str:
        """Ingest one file; its document id. The title is the file's name unless given."""
        found = self.spark.read.format("binaryFile").load(path)
        name = path.rstrip("/").rsplit("/", 1)[-1]
        rows = found.select("path", F.lit(name).alias("name"), "length", "content")
        docs, chunks = files.ingest(rows, self.config.chunk_size, self.config.chunk_overlap)
        docs = docs.withColumn("title", F.lit(title or name))
        self.ingest(docs, chunks)
        return docs.select("doc_id").first()[0]

    def ingest(self, docs: DataFrame, chunks: DataFrame, force: bool = False) -> None:
        """Upsert documents, chunks and CONTAINS edges. Documents whose content is there already are left out, unless ``force``."""
        old = graph_store.read(self.spark, self.folder, "documents")
        if not force:
            docs = dedup_by_hash(docs, old)
        docs = materialise(docs, "docs")
        chunks = materialise(chunks.join(docs.select("doc_id"), "doc_id", "left_semi"), "chunks")
        n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        docs = docs.join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("created_at", F.current_timestamp())
        self._upsert("documents", docs)
        self._upsert("chunks", self._embedded(chunks, F.col("text")))
        self._upsert("edges", lexical_edges(docs, chunks))

    def enrich(self, skip_communities: bool = False, doc_id: str | None = None) -> None:
        """Entities, relations, resolution, communities, topics, summaries, pruning; of one document only where given."""
        c = self.config
        chunks = graph_store.read(self.spark, self.folder, "chunks")
        some = chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)
        spans = E.ner_spans(some.select("chunk_id", "doc_id", "position", "text"), c.models.get("ner", E.capitalised_spans), c.ner_threshold)
        found = materialise(E.extract_triples(spans, c.models.get("extractor", E.chained_triples)), "extracted")
        triples = found.select("doc_id", F.explode("triples").alias("x")).select("doc_id", "x.*")
        named = found.select("doc_id", "chunk_id", "position", F.explode("spans").alias("s")).select("doc_id", "chunk_id", "position", "s.*")
        names = triples.select("doc_id", F.explode(F.array("h", "t")).alias("name")).unionByName(named.select("doc_id", F.col("text").alias("name")))
        mapping = materialise(E.coref(names, "doc_id", "name", c.coref_ratio, c.coref_tokens), "coref")
        relations = materialise(E.remap(triples, mapping, ["doc_id"]), "relations")
        said = found.withColumn("entities", F.transform("spans", lambda s: s["text"]))
        mentions = E.mentions(said).join(found.select("chunk_id", "doc_id"), "chunk_id").join(mapping, ["doc_id", "name"]).select("chunk_id", "doc_id", F.col("mapped").alias("name")).distinct()
        mentions = materialise(mentions, "mentions")
        labels = E.label_map(named, ["doc_id", "position"])
        all_names = relations.select(F.explode(F.array("h", "t")).alias("name")).unionByName(mentions.select("name")).distinct()
        ents = E.build(all_names.withColumn("llm_type", F.lit(None).cast("string")), labels)
        ents = ents.select(F.col("name").alias("entity_id"), "name", F.coalesce("ontology_class", "llm_type").alias("type"), "llm_type", F.array().cast("array<string>").alias("aliases"))
        as_node = ents.select("*", F.lit("ENTITY").alias("node_type"), F.lit(None).cast("string").alias("text"))
        ents = materialise(self._embedded(as_node, embedding_text()).select("entity_id", "name", "type", "llm_type", "aliases", "embedding"), "entities")
        edges = relations.select(F.col("h").alias("src"), F.col("t").alias("dst"), F.lit("RELATED_TO").alias("rel"), F.col("r").alias("relation_type"), F.col("doc_id").alias("scope_id"), F.lit("extraction").alias("source"), F.lit(None).cast("double").alias("weight"))
        said_edges = mentions.select(F.col("chunk_id").alias("src"), F.col("name").alias("dst"), F.lit("MENTIONS").alias("rel"), F.lit(None).cast("string").alias("relation_type"), F.col("doc_id").alias("scope_id"), F.lit("extraction").alias("source"), F.lit(1.0).alias("weight"))
        # resolution
        pairs = materialise(G.similarity_pairs(ents, c.similarity_threshold, "entity_id"), "pairs")
        members = G.clusters(pairs).join(ents.select(F.col("entity_id").alias("node"), "name"), "node")
        mapping = materialise(G.pick_canonical(members, G.degree(edges)), "canonical")
        aliases = G.merge_aliases(ents.withColumnRenamed("entity_id", "id"), mapping)
        ents = ents.join(mapping.where("node <> canonical").select(F.col("node").alias("entity_id")), "entity_id", "left_anti")
        ents = ents.join(aliases.select(F.col("canonical").alias("entity_id"), F.col("aliases").alias("more")), "entity_id", "left").withColumn("aliases", F.coalesce("more", "aliases")).drop("more")
        renamed = mapping.where("node <> canonical")
        edges = materialise(_renamed(edges, renamed), "edges")
        said_edges = _renamed(said_edges, renamed)
        self._upsert("entities", ents)
        self._upsert("edges", edges.unionByName(said_edges))
        if not skip_communities:
            self.topics()
        self.prune()

    def topics(self) -> None:
        """Communities of the entity graph as topics and subtopics, with summaries."""
        every = graph_store.read(self.spark, self.folder, "edges")
        related = every.where("rel = 'RELATED_TO'").select("src", "dst", "weight")
        assigned = materialise(C.communities(related, self.config.resolution), "communities")
        if assigned.isEmpty():
            return
        ids = C.local_numbers(assigned)
        subs = materialise(C.sub_communities(related, assigned).join(ids, "node").select(F.col("node").alias("entity_id"), "community_id", "sub_id"), "subs")
        nodes, edges = T.topic_hierarchy(subs)
        edges = materialise(edges, "hierarchy")
        mentions = every.where("rel = 'MENTIONS'").select(F.col("src").alias("chunk_id"), F.col("dst").alias("entity_id"))
        tasks = T.topic_tasks(T.topic_entities(edges), mentions, graph_store.read(self.spark, self.folder, "chunks"), 10)
        summarise = self.config.models.get("summariser", T.summarise)
        graph_store.write(T.apply_summaries(nodes, summarise(tasks)), self.folder, "topics")
        kept = every.where("rel NOT IN ('IN_TOPIC', 'PARENT_TOPIC')")
        graph_store.write(kept.unionByName(graph_store.conform(edges, "edges")), self.folder, "edges")
        ents = graph_store.read(self.spark, self.folder, "entities").drop("community_id")
        graph_store.write(ents.join(subs.select("entity_id", F.col("community_id").cast("string").alias("community_id")), "entity_id", "left"), self.folder, "entities")

    def prune(self) -> None:
        """Weak edges go, then entities that nothing links to, then those in components of fewer than ``min_component`` nodes without a topic, with their edges.

        Documents, chunks and the edges between them stay.
        """
        every = G.prune_edges(graph_store.read(self.spark, self.folder, "edges"), self.config.min_edge_weight)
        edges = materialise(every, "edges")
        ents = graph_store.read(self.spark, self.folder, "entities")
        kinds = graph_store.read(self.spark, self.folder, "topics").select("id", "node_type").distinct()
        linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(kinds, "id", "left")
        kept = materialise(G.prune_components(linked, edges, self.config.min_component).select("id"), "kept")
        graph_store.write(ents.join(kept.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi"), self.folder, "entities")
        inner = F.coalesce(F.col("rel") == "CONTAINS", F.lit(False))
        # both ends of an edge are in one component
        left = edges.where(~inner).join(kept.withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns)
        graph_store.write(edges.where(inner).unionByName(left), self.folder, "edges")

    def delete(self, doc_id: str) -> None:
        """Remove a document, its chunks and their edges; entities stay."""
        t = [graph_store.read(self.spark, self.folder, n) for n in ("documents", "chunks", "edges")]
        for name, left in zip(("documents", "chunks", "edges"), [materialise(x, "left") for x in U.delete_document(F.lit(doc_id), *t)]):
            graph_store.write(left, self.folder, name)

    def reprocess(self, doc_id: str) -> None:
        """Extract one document again."""
        edges = graph_store.read(self.spark, self.folder, "edges")
        stale = (F.col("scope_id") == doc_id) & F.col("rel").isin("RELATED_TO", "MENTIONS")
        graph_store.write(edges.where(~F.coalesce(stale, F.lit(False))), self.folder, "edges")
        self.enrich(doc_id=doc_id)

    # ---- questions -------------------------------------------------------------------

    def documents(self) -> DataFrame:
        return graph_store.read(self.spark, self.folder, "documents").orderBy(F.desc_nulls_first("created_at"), "doc_id")

    def document(self, doc_id: str) -> DataFrame:
        """One document with its chunks in order."""
        docs = graph_store.read(self.spark, self.folder, "documents").where(F.col("doc_id") == doc_id)
        own = graph_store.read(self.spark, self.folder, "chunks").where(F.col("doc_id") == doc_id)
        listed = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text"))).alias("chunks"))
        return docs.join(listed, "doc_id", "left")

    def analytics(self) -> DataFrame:
        t = {n: graph_store.read(self.spark, self.folder, n) for n in ("documents", "chunks", "entities", "edges")}
        return P.counts(documents=t["documents"], chunks=t["chunks"], entities=t["entities"], relationships=t["edges"])

    def search_chunks(self, text: str, k: int | None = None) -> DataFrame:
        chunks = graph_store.read(self.spark, self.folder, "chunks")
        found = R.vector_topk(chunks, self._query(text), k or self.config.chunk_k, "chunk_id")
        return R.with_parent(found, graph_store.read(self.spark, self.folder, "documents"))

    def search_entities(self, text: str, k: int | None = None) -> DataFrame:
        ents = graph_store.read(self.spark, self.folder, "entities")
        return R.entity_search(ents, self._query(text), text, k or self.config.entity_k, "name", "entity_id")

    def neighbours(self, entity: str, depth: int = 2, limit: int = 20) -> DataFrame:
        related = graph_store.read(self.spark, self.folder, "edges").where("rel = 'RELATED_TO'")
        seeds = self.spark.createDataFrame([(entity,)], "seed string")
        return G.khop(related, seeds, depth).orderBy("hops", "node").limit(limit)

    def context(self, doc_id: str) -> DataFrame:
        docs = graph_store.read(self.spark, self.folder, "documents").where(F.col("doc_id") == doc_id)
        return R.document_context(docs, graph_store.read(self.spark, self.folder, "chunks").where(F.col("doc_id") == doc_id))

    def schema(self) -> DataFrame:
        """``(labels, relationship_types, property_keys)`` of what is stored."""
        edges = graph_store.read(self.spark, self.folder, "edges")
        labels = [n for n in ("documents", "chunks", "entities", "topics") if not graph_store.read(self.spark, self.folder, n).isEmpty()]
        keys = sorted({f for n in graph_store.TABLES for f in graph_store.read(self.spark, self.folder, n).columns})
        kinds = edges.agg(F.sort_array(F.collect_set("rel")).alias("relationship_types"))
        return kinds.select(F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"), "relationship_types", F.array(*map(F.lit, keys)).alias("property_keys"))

    def answer(self, question: str) -> dict:
        """Cited passages, and the graph of passages and documents, for a question; the text is an extract unless a model is set."""
        found = materialise(self.search_chunks(question).withColumn("seq", F.row_number().over(_by_score())), "found")
        cited = [r.asDict(recursive=True) for r in R.citations(found).orderBy("seq").collect()]  # k rows at most
        nodes, edges = R.context_graph(found)
        write = self.config.models.get("writer", lambda q, c: " ".join(x["text_excerpt"] for x in c[:2]))
        return {"answer": write(question, cited), "citations": cited, "graph": {"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()]}}

    def stream(self, question: str) -> Iterator[dict]:
        """The answer as events: tokens, then citations and graph where there are any, then done."""
        out = self.answer(question)
        for token in out["answer"].split():
            yield {"type": "token", "data": token}
        if out["citations"]:
            yield {"type": "citation", "data": out["citations"]}
        if out["graph"]["nodes"]:
            yield {"type": "graph", "data": out["graph"]}
        yield {"type": "done", "data": None}

    # ---- helpers ---------------------------------------------------------------------

    def _embedded(self, rows: DataFrame, text: Column) -> DataFrame:
        return embed(rows, text, self.config.models.get("embedder", hashed_trigrams(self.config.dimensions)), self.config.embed_batch)

    def _query(self, text: str) -> list[float]:
        return [float(x) for x in self.config.models.get("embedder", hashed_trigrams(self.config.dimensions))()([text])[0]]

    def _upsert(self, table: str, new: DataFrame) -> None:
        keys = graph_store.KEYS[table]
        tag = F.concat_ws("\x1f", *[F.coalesce(F.col(k), F.lit("\x1e")) for k in keys])
        old = graph_store.read(self.spark, self.folder, table).withColumn("_k", tag)
        fresh = graph_store.conform(new, table).withColumn("_k", tag)
        graph_store.write(U.merge_nodes(old, fresh, "_k").drop("_k"), self.folder, table)

    def _lock(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_running")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p.getParent())
        if not fs.createNewFile(p):
            raise Running(f"a run holds {self.folder}")
        return lambda: fs.delete(p, False)


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "chunk_id")


def _renamed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends renamed; what became a self-loop goes, repeats too. Relations of several kinds stay apart."""
    e = edges.join(mapping.select(F.col("node").alias("src"), F.col("canonical").alias("_s")), "src", "left").join(mapping.select(F.col("node").alias("dst"), F.col("canonical").alias("_d")), "dst", "left")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return e.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), *rest).where("src <> dst").distinct()


def dedup_by_hash(new: DataFrame, old: DataFrame) -> DataFrame:
    """New documents whose content isn't stored yet, one for each content (the least id)."""
    first = new.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return new.join(first, ["content_hash", "doc_id"], "left_semi").join(old.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"]).select(*new.columns)


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that a crash left in ``processing`` become resumable errors."""
    stuck = F.col("status") == "processing"
    return jobs.withColumn("resumable", F.coalesce(stuck, F.lit(False))).withColumn("status", F.when(stuck, F.lit("error")).otherwise(F.col("status")))
