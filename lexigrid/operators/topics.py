"""Topics over communities: hierarchy, texts to summarise, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import clip_title, truncate


def concat_ordered(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Texts of each group joined by blanks in the order of ``(doc_id, position)``; empty ones are left out."""
    some = chunks.where("text IS NOT NULL AND text <> ''")
    listed = some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("doc_id", "position", "text"))).alias("t"))
    return listed.select(*by, F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def topic_hierarchy(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``(entity_id, community_id, sub_id)``: a topic for each community, a subtopic for each part of one.

    An entity hangs on its subtopic, or on the topic where it has none; subtopics hang on topics.
    """
    topic = F.concat(F.lit("TOPIC_"), F.col("community_id").cast("string"))
    sub = F.concat(F.lit("SUBTOPIC_"), F.col("community_id").cast("string"), F.lit("_"), F.col("sub_id").cast("string"))
    rows = assigned.select("entity_id", topic.alias("topic"), F.when(F.col("sub_id").isNotNull(), sub).alias("sub"))
    topics = rows.select(F.col("topic").alias("id"), F.lit("TOPIC").alias("node_type")).distinct()
    subs = rows.where("sub IS NOT NULL").select(F.col("sub").alias("id"), F.lit("SUBTOPIC").alias("node_type")).distinct()
    belongs = rows.select(F.col("entity_id").alias("src"), F.coalesce("sub", "topic").alias("dst"), F.lit("IN_TOPIC").alias("rel"))
    parents = rows.where("sub IS NOT NULL").select(F.col("sub").alias("src"), F.col("topic").alias("dst"), F.lit("PARENT_TOPIC").alias("rel")).distinct()
    return topics.unionByName(subs), belongs.unionByName(parents)


def parse_topic_id(topic: Column) -> tuple[Column, Column]:
    """Community and part of ids such as TOPIC_3 and SUBTOPIC_3_1."""
    parts = F.split(topic, "_")
    return parts[1].try_cast("int"), F.get(parts, F.lit(2)).try_cast("int")


def topic_entities(edges: DataFrame) -> DataFrame:
    """``(topic, entity_id)``: entities of a topic itself and of its subtopics."""
    direct = edges.where("rel = 'IN_TOPIC'").select(F.col("dst").alias("topic"), F.col("src").alias("entity_id"))
    up = edges.where("rel = 'PARENT_TOPIC'").select(F.col("src").alias("topic"), F.col("dst").alias("parent"))
    through = direct.join(up, "topic").select(F.col("parent").alias("topic"), "entity_id")
    return direct.unionByName(through).distinct()


def topic_tasks(members: DataFrame, mentions: DataFrame, chunks: DataFrame, fallback: int = 0) -> DataFrame:
    """``(task_id, concatenated_text, chunk_ids, entity_ids)`` of each topic; blank ones are left out.

    ``members(topic, entity_id)``, ``mentions(chunk_id, entity_id)``. With ``fallback``, topics without chunks take
    the first so many chunks of the corpus.
    """
    ents = members.groupBy("topic").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    linked = members.join(mentions, "entity_id").select("topic", "chunk_id").distinct()
    texts = linked.join(chunks.select("chunk_id", "doc_id", "position", "text"), "chunk_id")
    if fallback:
        bare = members.select("topic").distinct().join(linked.select("topic").distinct(), "topic", "left_anti")
        first = chunks.select("chunk_id", "doc_id", "position", "text").orderBy("doc_id", "position").limit(fallback)
        texts = texts.select("topic", "chunk_id", "doc_id", "position", "text").unionByName(bare.crossJoin(F.broadcast(first)).select("topic", "chunk_id", "doc_id", "position", "text"))
    listed = texts.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("doc_id", "position", "chunk_id", "text"))).alias("t"))
    out = listed.select(
        F.col("topic"),
        F.array_join(F.filter(F.transform("t", lambda x: x["text"]), lambda x: x != ""), " ").alias("concatenated_text"),
        F.transform("t", lambda x: x["chunk_id"]).alias("chunk_ids"),
    )
    return out.where("trim(concatenated_text) <> ''").join(ents, "topic").select(F.col("topic").alias("task_id"), "concatenated_text", "chunk_ids", "entity_ids")


def summarise(tasks: DataFrame, most: int = 12000) -> DataFrame:
    """Built-in surrogate of a summarising model: title = first sentence, summary = leading sentences of the truncated text."""
    text = truncate(F.col("concatenated_text"), most)
    title = clip_title(F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1))
    summary = truncate(text, 600)
    return tasks.withColumn("title", title).withColumn("summary", F.when(F.trim(summary) == "", F.lit("No summary available.")).otherwise(summary))


def apply_summaries(topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Topic nodes with what was summarised: a value that is missing or empty keeps the old one."""
    s = summaries.select(F.col("task_id").alias("id"), F.col("title").alias("new_title"), F.col("summary").alias("new_summary"), "chunk_ids", "entity_ids")
    old = {c: F.col(c) if c in topics.columns else F.lit(None).cast("string") for c in ("title", "summary")}
    rest = [c for c in topics.columns if c not in ("title", "summary", "chunk_ids", "entity_ids", "has_summary")]
    out = topics.join(s, "id", "left")
    return out.select(
        *rest,
        F.coalesce(F.nullif("new_title", F.lit("")), old["title"]).alias("title"),
        F.coalesce(F.nullif("new_summary", F.lit("")), old["summary"]).alias("summary"),
        "chunk_ids",
        "entity_ids",
        F.col("new_summary").isNotNull().alias("has_summary"),
    )
