"""Upserts and deletes on graph tables. Each gives the new table; the caller writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _holds_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_holds_map(f.dataType) for f in t)
    return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and _holds_map(t.elementType)


def last_of_each(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each ``key``: the one that is last by ``order``; of equals, and without an order, the one that a hash over all columns puts last.

    So the row does not depend on how ``df`` is partitioned.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    hashed = F.xxhash64(*[F.to_json(F.struct(c)) if _holds_map(f.dataType) else c for c, f in zip(cols, df.schema)])
    rank = F.struct(F.col(order), hashed) if order else hashed
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*cols), rank).alias("r")).select("r.*")


def merge_nodes(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert or overlay by ``key``: a property that the new row lacks, or has as null, keeps its value. Rows without a key are no nodes.

    Of new rows with one key the last by ``order`` counts (``last_of_each``).
    """
    new = last_of_each(new.where(F.col(key).isNotNull()), key, order)
    names = [key] + [c for c in dict.fromkeys(old.columns + new.columns) if c != key]
    o, n = old.alias("o"), new.alias("n")
    cols = []
    for c in names:
        sides = [F.col(f"{a}.`{c}`") for a, t in (("n", new), ("o", old)) if c in t.columns]
        cols.append(F.coalesce(*sides).alias(c))
    return o.join(n, F.col(f"o.`{key}`") == F.col(f"n.`{key}`"), "full").select(*cols)


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The same for edges by ``(src, rel, dst)``; a new edge without both ends among the nodes is dropped."""
    ids = nodes.select(F.col(key).alias("_id"))
    new = new.join(ids.withColumnRenamed("_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("_id", "dst"), "dst", "left_semi")
    tag = F.struct("src", "rel", "dst")
    out = merge_nodes(old.withColumn("_k", tag), new.withColumn("_k", tag), "_k")
    return out.drop("_k")


def delete_document(doc_id: Column, documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without one document, its chunks and every edge at either; entities stay."""
    gone = chunks.where(F.col("doc_id") == doc_id).select(F.col("chunk_id").alias("_g")).unionByName(documents.where(F.col("doc_id") == doc_id).select(F.col("doc_id").alias("_g")))
    left = edges.join(gone.withColumnRenamed("_g", "src"), "src", "left_anti").join(gone.withColumnRenamed("_g", "dst"), "dst", "left_anti").select(*edges.columns)
    return documents.where(F.col("doc_id") != doc_id), chunks.where(F.col("doc_id") != doc_id), left


def classify(node_type: Column, kind: Column) -> Column:
    """Label under which a working node is stored; null for what isn't stored."""
    t = F.upper(F.coalesce(node_type, kind))
    return F.when(t == "DOCUMENT", "Document").when(t == "CHUNK", "Chunk").when(t.isin("ENTITY", "ENTITY_CONCEPT"), "Entity").when(t == "TOPIC", "Topic").when(t == "SUBTOPIC", "Subtopic")


def classify_edge(graph_type: Column, label: Column) -> Column:
    """Relationship under which a working edge is stored."""
    l, g = F.upper(label), F.upper(graph_type)
    found = F.when(l.isin("CONTAINS", "HAS_CHUNK"), "CONTAINS").when(l.isin("MENTIONS", "HAS_ENTITY"), "MENTIONS").when(l.isin("IN_TOPIC", "PARENT_TOPIC"), l)
    return found.when((g == "ENTITY_RELATION") | l.isNotNull(), "RELATED_TO")


def clean_properties(df: DataFrame) -> DataFrame:
    """Columns as a property store takes them: structs, maps and lists that aren't numeric, and empty lists, become JSON strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            cols.append(c.alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(c).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            cols.append(c.alias(f.name))
    return df.select(*cols)
