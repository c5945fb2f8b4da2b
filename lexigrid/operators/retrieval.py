"""Retrieval: vector and keyword search, fusion, context and citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexigrid.functions import vectors as V
from lexigrid.functions.text import excerpt, words
from lexigrid.shipping import extended, map_arrow
from lexigrid.storage import materialise, tasks

#: Queries whose vectors are broadcast at once.
QUERY_BYTES = 32 << 20
#: Meetings of a query's word with a document that one task sums up.
PAIRS = 8_000_000
#: Rows and queries that a task compares at once, and pairs of vectors that it scores at once.
TILE_ROWS, TILE_QUERIES, EXACT_ROWS = 4096, 1024, 1 << 14


def vector_topk(rows: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding", mode: str = "cosine") -> DataFrame:
    """``rows`` with ``score``: the ``k`` nearest to one query vector, ties by key. Rows without a vector are out."""
    scored = rows.where(F.col(vector).isNotNull()).withColumn("score", V.cosine(F.col(vector), V.literal(query), mode))
    return scored.orderBy(F.desc("score"), key).limit(k)


def batch_topk(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", query_key: str = "query_id", most: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` nearest rows of every query, ties by id.

    Query vectors are broadcast part by part, each part of a bounded size. A task compares a tile of
    them with a tile of its rows at a time and keeps the best ``k`` of each query, so its memory follows
    neither number and the shuffle carries candidates only.
    """
    kinds = dict(rows.dtypes)
    qtype = to_arrow_type(queries.schema[query_key].dataType)
    schema = f"query_id {dict(queries.dtypes)[query_key]}, id {kinds[key]}, score double"
    out = None
    for ids, vectors in _query_parts(queries.select(query_key, vector), most):
        shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            near, kind = None, None
            for b in batches:
                if b.num_rows:
                    near = near or Nearest(q, k)
                    near.add(b.column("id"), V.matrix(b.column("v")))
                    kind = b.schema.field("id").type
            asked = pa.array(ids, qtype)
            for at, found, score in near.best() if near else ():
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(at)), pa.array(found.tolist(), kind), pa.array(score)], ["query_id", "id", "score"])

        part = map_arrow(rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")), run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Nearest:
    """The best ``k`` rows of each query among those added so far.

    A product in single precision finds what may be among them; those few are scored in double precision,
    summed in order as ``vectors.cosine`` is, so equal vectors get equal scores wherever they stand.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.q, self.k = queries, k
        self.length = V.lengths(queries.astype(np.float64))
        self.unit = (queries / self.length[:, None]).astype(np.float32)
        self.floor = np.full(len(queries), -np.inf, np.float32)
        self.slack = np.float32((queries.shape[1] + 4) * 2.0**-22)  # twice what single precision may be off
        self.at, self.key, self.score = np.empty(0, np.int64), None, np.empty(0)

    def add(self, ids: pa.Array, x: np.ndarray) -> None:
        keys = ids.to_numpy(zero_copy_only=False)
        for i in range(0, len(x), TILE_ROWS):
            own = x[i : i + TILE_ROWS]
            length = V.lengths(own)
            unit = (own / length[:, None]).astype(np.float32).T
            by_key = np.empty(len(own), np.int64)
            by_key[np.argsort(keys[i : i + TILE_ROWS], kind="stable")] = np.arange(len(own))
            found = [self._tile(j, own, length, unit, by_key) for j in range(0, len(self.q), TILE_QUERIES)]
            at, row, score = (np.concatenate(c) for c in zip(*found))
            key = keys[i : i + TILE_ROWS][row]
            self._keep(np.concatenate([self.at, at]), key if self.key is None else np.concatenate([self.key, key]), np.concatenate([self.score, score]))

    def _tile(self, j: int, x: np.ndarray, length: np.ndarray, unit: np.ndarray, by_key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries from ``j`` on, rows of the tile and scores: the best ``k`` of each query, if they may be among its best at all."""
        s = self.unit[j : j + TILE_QUERIES] @ unit
        low = self.floor[j : j + TILE_QUERIES]
        groups = max(self.k, 64)
        each = s.shape[1] // groups
        if each:  # the maxima of so many groups: at least k scores reach the k-th of them
            top = s[:, : groups * each].reshape(len(s), groups, each).max(axis=2)
            low = np.maximum(low, np.partition(top, groups - self.k, axis=1)[:, groups - self.k])
        at, row = np.nonzero(s >= (low - self.slack)[:, None])
        at += j
        score = np.empty(len(at))
        for c in range(0, len(at), EXACT_ROWS):
            p, r = at[c : c + EXACT_ROWS], row[c : c + EXACT_ROWS]
            dots = np.cumsum(self.q[p].astype(np.float64) * x[r], axis=1)[:, -1]
            score[c : c + EXACT_ROWS] = dots / (self.length[p] * length[r])
        keep, _ = self._first(at, score, by_key[row])
        return at[keep], row[keep], score[keep]

    def _keep(self, at: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        by_key = key if key.dtype != object else np.unique(key, return_inverse=True)[1]
        keep, place = self._first(at, score, by_key)
        self.at, self.key, self.score = at[keep], key[keep], score[keep]
        last = place == self.k - 1
        self.floor[self.at[last]] = self.score[last]

    def _first(self, at: np.ndarray, score: np.ndarray, by_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the best ``k`` of each query stand, and the place of each."""
        order = np.lexsort((by_key, -score, at))
        sorted_ = at[order]
        place = np.arange(len(at)) - np.searchsorted(sorted_, sorted_)
        keep = place < self.k
        return order[keep], place[keep]

    def best(self, rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(self.at), rows):
            yield self.at[i : i + rows], self.key[i : i + rows], self.score[i : i + rows]


def _query_parts(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    kind = np.float32 if queries.dtypes[1][1] == "array<float>" else np.float64
    ids, vectors, size = [], [], 0
    for r in queries.toLocalIterator():
        if r[1] is None:
            continue
        v = np.asarray(r[1], kind)
        ids.append(r[0])
        vectors.append(v)
        size += 8 * len(v)
        if size >= most:
            yield ids, np.stack(vectors)
            ids, vectors, size = [], [], 0
    if ids:
        yield ids, np.stack(vectors)


def entity_contains(entities: DataFrame, text: str, k: int | None = None, name: str = "name", key: str = "id") -> DataFrame:
    """Entities whose name contains the text in any case, with score 1; the first ``k`` by key."""
    found = entities.where(F.contains(F.lower(name), F.lit(text.lower()))).withColumn("score", F.lit(1.0))
    return found if k is None else found.orderBy(key).limit(k)


def entity_search(entities: DataFrame, query: list[float] | None, text: str, k: int = 10, name: str = "name", key: str = "id") -> DataFrame:
    """Nearest entities by vector; where that finds none, by name."""
    by_name = entity_contains(entities, text, k, name, key)
    if not query:
        return by_name
    near = vector_topk(entities, query, k, key)
    none = near.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return near.unionByName(by_name.join(F.broadcast(none), F.lit(True), "left_semi"))


def with_parent(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Found chunks with ``doc_title``; a chunk without its document is dropped."""
    return found.join(documents.select("doc_id", F.col("title").alias("doc_title")), "doc_id")


def document_context(documents: DataFrame, chunks: DataFrame, sample: int = 5) -> DataFrame:
    """Each document with the texts of its first chunks, in order."""
    first = chunks.where(F.col("position") < sample) if _dense(chunks) else chunks
    listed = first.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "text"))), 1, sample).alias("s"))
    return documents.join(listed, "doc_id", "left").select(*documents.columns, F.coalesce(F.transform("s", lambda x: x["text"]), F.array().cast("array<string>")).alias("sample_chunks"))


def _dense(chunks: DataFrame) -> bool:
    """Positions of our own chunkers count from 0 without gaps; those of slides may have some."""
    return "heading_path" not in chunks.columns


def citations(found: DataFrame, order: str = "seq") -> DataFrame:
    """One citation for each chunk, in the order of its first appearance."""
    w = Window.partitionBy("chunk_id").orderBy(order)
    first = found.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return first.select("chunk_id", "doc_id", "doc_title", excerpt(F.col("text")).alias("text_excerpt"), F.coalesce("score", F.lit(0.0)).alias("score"), order)


def context_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and CONTAINS edges of found chunks and their documents."""
    doc = F.coalesce("doc_id", F.lit("unknown_doc"))
    nodes = found.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label")).unionByName(found.select(doc.alias("id"), F.lit("Document").alias("label"))).distinct()
    return nodes, found.select(doc.alias("src"), F.col("chunk_id").alias("dst"), F.lit("CONTAINS").alias("rel")).distinct()


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """``(query_id, doc_id, score, rank)`` by BM25 over lower-case words.

    Documents are read once: of their words only those that some query has go on, and an empty one for each document,
    which carries the totals. Their counts are dealt by document, so that scores are summed where they are made.
    """
    wanted = materialise(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.lower("text")))).alias("term")), "wanted")
    terms = materialise(wanted.select(F.explode(F.array("term", F.lit(""))).alias("term")).distinct(), "terms")
    tokens = docs.select(F.col(doc_id).alias("doc_id"), words(F.lower("text")).alias("w"))
    each = tokens.select("doc_id", F.size("w").alias("dl"), F.explode(F.concat("w", F.array(F.lit("")))).alias("term")).join(terms, "term", "left_semi")
    tf = materialise(each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    totals = tf.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")).cast("double") / F.sum("tf")).alias("avgdl"))
    df = materialise(tf.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    # one row of totals
    known = df.join(wanted, "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = materialise(known.select("query_id", "term", "avgdl", "df", idf.alias("idf")), "known")
    met = known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = tf.where("term <> ''").repartition(tasks(tf.sparkSession, met, PAIRS) or int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").join(known, "term")
    s = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum(s), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(ranked: list[DataFrame], k: int = 60, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of rankings ``(query_id, doc_id, rank)`` with ranks from 1."""
    out = None
    for r in ranked:
        part = r.select(by, item, (F.lit(1.0) / (k + F.col("rank"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(by, item).agg(F.round(F.sum("s"), 9).alias("score"))


def rerank(candidates: DataFrame, load, k: int, query: str = "query", text: str = "text", by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The best ``k`` of each query by a pair-scoring model; ``load()`` gives ``f(queries, texts) -> scores`` once for each worker."""
    rows = candidates.select(F.struct(*[F.col(f"`{c}`") for c in candidates.columns]).alias("r"))
    schema = extended(rows.schema, "rerank_score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            r = b.column("r")
            scores = model(r.field(query).to_pylist(), r.field(text).to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([r, pa.array(list(scores), pa.float64())], ["r", "rerank_score"])

    scored = map_arrow(rows, run, schema).select("r.*", "rerank_score")
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def word_overlap():
    """Surrogate of a cross-encoder: Jaccard similarity of the lower-case words."""

    def run(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts):
            x, y = set((q or "").lower().split()), set((t or "").lower().split())
            out.append(len(x & y) / len(x | y) if x and y else 0.0)
        return out

    return run


def similar(a: Column, b: Column) -> Column:
    return V.cosine(a, b)
