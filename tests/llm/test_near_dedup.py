import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import near_dedup as N

SCHEMA = "doc_id long, text string"


def sets(texts):
    out = {}
    for i, _, s, off in N.shingle_sets(pa.array(texts, pa.string())):
        for k in range(len(off) - 1):
            out[i + k] = frozenset(s[off[k] : off[k + 1]].tolist())
    return [out.get(k, frozenset()) for k in range(len(texts))]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(texts, candidate):
    """Components of the candidate pairs that are similar enough, by union-find over all pairs."""
    s = sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and (s[i] == s[j] or candidate(i, j) and jaccard(s[i], s[j]) >= N.THRESHOLD):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, find(i)) for i in range(len(texts)) if find(i) != i}


def share_a_table(texts, m=N.TABLES, r=N.HASHES):
    got = {}
    for i, _, s, off in N.shingle_sets(pa.array(texts, pa.string())):
        full = np.flatnonzero(np.diff(off) > 0)
        if len(full):
            for row, keys in zip(full, N.sub_keys(s, np.append(off[full], len(s)), m, r)):
                got[i + row] = keys

    def check(i, j):
        x, y = got[i] == got[j]
        return bool(x.any() and y.any())

    return check


def corpus(seed, families=12):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    boiler = [word() for _ in range(25)]
    texts = []
    for f in range(families):
        base = [word() for _ in range(rng.choice([4, 20, 60, 150]))] + (boiler if f % 2 else [])
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 8))):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    return {(r["doc_id"], r["near_copy_of"]) for r in N.near_duplicates(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_the_candidates(spark, seed):
    texts = corpus(seed)
    want = groups(texts, share_a_table(texts))
    assert len(want) > 10 and run(spark, texts) == want


def test_recall_at_the_threshold_against_all_pairs():
    # pairs with Jaccard similarity of just 0.5: 2n shared of 3n shingles each way
    rng = np.random.default_rng(5)
    hit, n = 0, 600
    for _ in range(n):
        x = rng.choice(1 << 32, 120, replace=False).astype(np.uint32)
        a, b = np.sort(x[:90]), np.sort(np.concatenate((x[:60], x[90:])))
        assert N.jaccard(a, b) == 0.5
        ka, kb = N.sub_keys(np.concatenate((a, b)), np.array([0, 90, 180]), N.TABLES, N.HASHES)
        x, y = ka == kb
        hit += bool(x.any() and y.any())
    assert hit / n >= 0.88  # 0.917 expected


def test_a_bucket_of_unlike_texts_is_compared_whole(spark, monkeypatch):
    """With one table of one hash, unlike texts share buckets: centres are not enough, and no link is lost."""
    texts = corpus(9, 20)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for rounds in (0, 2):
        monkeypatch.setattr(N, "ROUNDS", rounds)
        got = {(r["doc_id"], r["near_copy_of"]) for r in N.near_duplicates(df, m=1, r=1).collect()}
        assert got == groups(texts, share_a_table(texts, 1, 1))


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    real = N._fingerprint
    monkeypatch.setattr(N, "_fingerprint", lambda s, off: (np.zeros(len(off) - 1, np.uint64), real(s, off)[1]))
    rows = pa.record_batch({"d": pa.array([1, 2]), "h": pa.array([1, 2]), "text": pa.array(["a b c d", "e f g h"])})
    got = next(N._signatures(2, 1, 3)(iter([rows]))).to_pydict()
    assert got["sid"] == [0, 0] and got["other"][0] != got["other"][1]


def test_nulls_repeats_ties_and_clashing_columns(spark):
    t = "one two three four five six seven eight"
    rows = [(5, t), (5, t), (2, t.upper()), (None, t + " "), (None, None), (3, None), (4, ""), (6, " \t\n"), (8, "x"), (9, "X")]
    df = spark.createDataFrame([(i, x, "s", 1, 2) for i, x in rows], "doc_id long, text string, sid string, k int, `a.b` int")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, 2), (None, 2), (9, 8)], key=repr)
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(2, t.upper()), (None, None), (3, None), (4, ""), (6, " \t\n"), (8, "x")], key=repr)
    assert N.near_duplicates(df.limit(0)).count() == N.drop_near_duplicates(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join("v%d" % (i % 9000) for i in range(400_000))
    got = run(spark, [long, "a b c d", long + " tail", long.replace("v17 ", "u ", 1)])
    assert got == {(2, 0), (3, 0)}
