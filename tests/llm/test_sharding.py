import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import sharding as S


def plain(names, slots):
    """Each shard in turn takes the next free slot of its whole permutation, written out."""
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % max(1, slots - 1) + 1
        orders.append([(start + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("shards,slots", [(1, 2), (3, 7), (5, 31), (7, 211), (31, 31)])
def test_slots_are_taken_in_turn(shards, slots):
    names = [f"s{i}" for i in range(shards)]
    table = S.lookup_table(names, slots)
    assert table == plain(names, slots)
    sizes = Counter(table)
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1


def test_few_slots_move_when_a_shard_joins():
    names = [f"s{i}" for i in range(16)]
    a, b = S.lookup_table(names, 4093), S.lookup_table([*names, "new"], 4093)
    assert sum(x != y for x, y in zip(a, b)) < 0.12 * 4093  # 1/17 must move


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_what_is_no_table(names, slots):
    with pytest.raises(ValueError):
        S.lookup_table(names, slots)


def test_rows_keep_their_shard_however_they_are_spread(spark):
    rows = [(i % 50 if i % 7 else None, "t%d" % i if i % 5 else None, 1, 2) for i in range(400)] + [(3, "x" * 200_000, 1, 2)] + [(9, "hot", 1, 2)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, Slot int, `o.s` int")
    table = S.lookup_table([f"shard-{i:05d}" for i in range(8)], 31)

    def want(d):
        s = int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16) % 31
        return s, table[s]

    for spread in (None, 0, 1, 3):
        out = S.shard_documents(df, 8, 31, spread=spread)
        got = out.select("doc_id", "text", "slot", "shard", F.spark_partition_id().alias("p")).collect()
        assert Counter((r[0], r[1], (r[2], r[3])) for r in got) == Counter((d, t, want(d)) for d, t, _, _ in rows)
        if spread != 0:
            of = {}
            for r in got:
                assert of.setdefault(r["p"], r["shard"]) == r["shard"]
    assert out.columns == ["doc_id", "text", "o.s", "slot", "shard"]
    assert S.shard_documents(df.limit(0)).count() == 0


def test_the_table_is_broadcast_and_the_data_move_once(spark):
    plan = S.shard_documents(spark.range(10).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange ") <= 2
