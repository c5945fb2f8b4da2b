import random
from collections import defaultdict

import pytest

from lexigrid.llm import exact_dedup as E
from lexigrid.llm.common import repeated

SCHEMA = "doc_id long, text string"


def brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        if t is not None:
            groups[t].append(d)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda d: (d is None, d))
        out += [(d, ids[0], len(ids)) for d in ids[1:]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first,widen", [(1, 2), (3, 2), (E.FIRST, E.WIDEN)])
def test_groups_of_equal_texts(spark, first, widen):
    rng = random.Random(first)
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "aa", "aé", "aéa", "b" * 47, "b" * 48, "b" * 49, "b" * 500, "b" * 499 + "c", "c" + "b" * 499])) for _ in range(120)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], SCHEMA + ", n int, `a.b` int").repartition(3)
    assert sorted(map(tuple, E.exact_duplicates(df, first, widen).collect()), key=repr) == brute(docs)


def test_long_texts_that_differ_at_the_end(spark):
    t = "x" * 300_000
    docs = [(1, t), (2, t + "a"), (3, t + "b"), (4, t + "a")]
    assert [tuple(r) for r in E.exact_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()] == [(4, 2, 2)]
    assert E.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_repeat_in_steps(spark, monkeypatch):
    from lexigrid.llm import common

    monkeypatch.setattr(common, "STEP", 4)
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 4), (4, 5), (5, 13), (6, None)], "v int, m long")
    got = sorted(r[0] for r in repeated(df, "m").collect())
    assert got == [1] + [3] * 4 + [4] * 5 + [5] * 13
