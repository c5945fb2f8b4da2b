"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table. Shards
take turns claiming the next free slot of their permutation until every slot
is taken, so shares differ by at most one slot and few slots move when a shard
joins or leaves. The table has a fixed size, whatever the data: it is broadcast
and placing a document is one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import packed

SHARDS = 64
SLOTS = 16381
#: Rows of a shard are spread over so many partitions for each partition that the session gives a shuffle, and one at least.
SPREAD = 4


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot. ``slots`` is prime, at least the number of shards."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be there, and differ")
    if not _prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime, at least the number of shards")
    digests = [hashlib.sha256(n.encode()).digest() for n in names]
    offset = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % max(1, slots - 1) + 1 for d in digests]
    table, turn, left = [-1] * slots, [0] * len(names), slots
    while left:
        for i in range(len(names)):
            while table[s := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            table[s] = i
            turn[i] += 1
            left -= 1
            if not left:
                break
    return table


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", spread: int | None = None) -> DataFrame:
    """Rows of ``docs`` with ``slot`` and ``shard``; every partition holds rows of one shard.

    ``spread`` says over how many partitions a shard goes, by the hash of the row; 0 leaves rows where they are. Where it is not given,
    shards share four times ``spark.sql.shuffle.partitions`` among them. So a shard's size,
    be it that of a hot key, is not a task's.

    The slot is the first 8 hexadecimal digits of the key's MD5 (of the empty
    string where the key is null) modulo ``slots``: rows alike in the key
    always share a shard. Columns of the input named ``slot`` or ``shard`` (in
    any case) give way to the new ones. Texts, null or of any length, are only carried.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    table = lookup_table([f"shard-{i:05d}" for i in range(shards)], slots)
    owners = spark.createDataFrame(list(enumerate(table)), "s long, o int")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    rows = docs.select(F.struct(*kept).alias("r"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"))
    rows = rows.select("r", F.pmod(F.conv(F.substring(F.md5("k"), 1, 8), 16, 10).cast("long"), F.lit(slots)).alias("s"))
    # the table holds ``slots`` rows whatever the data, hence the plain broadcast
    placed = rows.join(F.broadcast(owners), "s")
    if spread is None:
        spread = max(1, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    if spread:
        salt = F.pmod(F.xxhash64("r"), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
        placed = placed.repartitionById(shards * spread, F.col("o") * F.lit(spread) + salt)
    return placed.select("r.*", F.col("s").alias("slot"), F.col("o").alias("shard"))


def sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, lookup_table([f"shard-{i:05d}" for i in range(shards)], slots)))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS owners),
d AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {slots} AS slot FROM documents)
SELECT d.*, CAST(t.owners[d.slot + 1] AS INTEGER) AS shard FROM d CROSS JOIN t"""
