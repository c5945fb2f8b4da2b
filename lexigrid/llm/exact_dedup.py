"""Exact dedup by distributed MSD radix partitioning.

A document counts as the string of its byte length followed by its bytes, so
the first digit separates the lengths. Documents of one group are split by the
next run of bytes; a group with one document is settled, and so is a group
whose documents have ended: they are equal, byte by byte, and no digest
stands for a text. Digits widen as groups shrink, so the number of rounds
grows with the logarithm of the longest text.

The first round reads a narrow projection of every document. Texts move only
for documents that share length and first bytes with another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import beside, id_of, repeated, row_key
from lexigrid.storage import discard, materialise

FIRST = 48
WIDEN = 8


def radix_groups(docs: DataFrame, first: int = FIRST, widen: int = WIDEN) -> DataFrame:
    """``(key, lead, size)`` of every row whose text is also another row's; ``lead`` is the group's least key."""
    text = F.col("text")
    rows = docs.where(text.isNotNull()).select(row_key().alias("key"), F.encode(text, "UTF-8").alias("b"))
    digit = rows.select("key", F.length("b").alias("n"), F.substring("b", 1, first).alias("c"))
    shared = digit.groupBy("n", "c").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("lead")).where("size > 1")
    shared = materialise(shared, "radix")
    settled = []
    # ended within the first digit: nothing is left to compare
    short = shared.where(F.col("n") <= first)
    settled.append(digit.where(F.col("n") <= first).join(short, ["n", "c"]).select("key", "lead", "size"))
    live = rows.withColumn("n", F.length("b")).where(F.col("n") > first).withColumn("c", F.substring("b", 1, first))
    live = live.join(beside(shared, 2 * first + 64).where(F.col("n") > first).withColumnRenamed("lead", "g"), ["n", "c"])
    live = materialise(live.select("g", "key", "n", F.expr(f"substring(b, {first + 1})").alias("b")), "radix")
    done, width = first, first * widen
    while not live.isEmpty():
        step = live.withColumn("c", F.substring("b", 1, width))
        split = materialise(step.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("lead")).where("size > 1"), "radix")
        step = step.join(split, ["g", "c"])
        done += width
        settled.append(materialise(step.where(F.col("n") <= done).select("key", "lead", "size"), "radix"))
        nxt = step.where(F.col("n") > done)
        nxt = materialise(nxt.select(F.col("lead").alias("g"), "key", "n", F.expr(f"substring(b, {width + 1})").alias("b")), "radix")
        discard(live, split)
        live, width = nxt, width * widen
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def exact_duplicates(docs: DataFrame, first: int = FIRST, widen: int = WIDEN) -> DataFrame:
    """Redundant copies: ``(doc_id, copy_of, copies)``, one row for each row beyond the first of its group.

    ``copy_of`` is the doc_id of the group's least key (doc_id ascending, null
    last), ``copies`` the number of rows with that very text. Documents with a
    text of their own do not appear. A null text equals nothing; empty texts
    equal each other. Rows repeated with the same doc_id: the surplus ones
    appear as copies of that doc_id. An empty table gives no rows. Texts of any length are compared whole, in rounds; of extra columns none is read.
    """
    g = radix_groups(docs, first, widen)
    # rows that repeat the lead's key come as often as they are there; one of them is the one that stays
    counted = g.groupBy("key", "lead", "size").agg(F.count(F.lit(1)).alias("m"))
    counted = counted.withColumn("m", F.when(F.col("key") == F.col("lead"), F.col("m") - 1).otherwise(F.col("m"))).where("m > 0")
    return repeated(counted.select(id_of(F.col("key.d")).alias("doc_id"), id_of(F.col("lead.d")).alias("copy_of"), F.col("size").alias("copies"), "m"), "m")


SQL = """
SELECT doc_id, copy_of, copies FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS copy_of, row_number() OVER w AS k,
         count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST))
WHERE k > 1"""
