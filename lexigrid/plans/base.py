"""Fixtures that several queries share: as DataFrames, and as SQL for DuckDB (``WITH`` parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import chunking
from lexigrid.storage import spread

SIZE, OVERLAP = 120, 20
SIMILAR = 0.4


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The persisted document table: hash, prefix of it as key of content, title."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.sha2("text", 256).alias("content_hash"), "text", "lang")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_words(table(spark, d, "documents"), SIZE, OVERLAP)


def entities(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    return t.select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("entity_id"), F.col("label").cast("string").alias("type"), "embedding", "vec_id")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edges supplier -> part: the mean discount of their line items."""
    items = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    t = spread(items, items.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_discount").alias("weight"))
    return t.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "weight")


def links(spark: SparkSession, d: str) -> DataFrame:
    """The same edges without weights, once for each line item: for what asks only whether there is one."""
    t = table(spark, d, "lineitem")
    return t.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


CHUNKS = f"""chunks AS (
  SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(p AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(p AS INTEGER) AS position,
         array_to_string(w[p * {SIZE - OVERLAP} + 1 : p * {SIZE - OVERLAP} + {SIZE}], ' ') AS text, len(w[p * {SIZE - OVERLAP} + 1 : p * {SIZE - OVERLAP} + {SIZE}]) AS token_count
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) d,
       unnest(range(0, (len(w) + {SIZE - OVERLAP - 1}) // {SIZE - OVERLAP})) u(p))"""
DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, sha256(text) AS content_hash, text, lang FROM documents)"
ENTITIES = "entities AS (SELECT 'e' || CAST(vec_id AS VARCHAR) AS entity_id, CAST(label AS VARCHAR) AS type, embedding, vec_id FROM embeddings)"
RELATIONS = "relations AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, avg(l_discount) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)"
