import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(docs, least=L.MIN_CHARS):
    """All pairs of lines, in the order of documents and lines; ids are unique."""
    spots = [(i, k, x.strip(" \t\r")) for i, t in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0])) for k, x in enumerate(t.split("\n"))]
    spots = [s for s in spots if s[2]]
    gone = set()
    for n, (i, k, x) in enumerate(spots):
        for _, _, y in spots[:n]:
            if x == y or len(x) >= least and len(y) >= least and within_one(x, y):
                gone.add((i, k))
                break
    out = []
    for i, t in docs:
        if t is None or not any(d == i for d, _ in gone):
            out.append((i, t))
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if any(x.strip(" \t\r") for x in kept):
            out.append((i, "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    return sorted(((r["doc_id"], r["text"]) for r in L.dedup_lines(df, **more).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé \U0001f600") for _ in range(rng.choice([1, 5, 23, 24, 25, 30, 61]))) for _ in range(25)]

    def line():
        t = list(rng.choice(pool))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "a", "z"])
        return rng.choice(["", " ", "\t"]) + "".join(t) + rng.choice(["", "\r", "  "])

    return [(i if i else None, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(30)] + [(100, None), (101, ""), (102, "\n \n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_of_lines(spark, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert want != sorted(docs, key=repr) and run(spark, docs) == want


def test_every_length_has_a_neighbourhood_if_asked(spark):
    docs = corpus(3)
    assert run(spark, docs, min_chars=1) == brute(docs, 1)


def test_keys_of_variants_are_keys_of_the_shorter_texts(monkeypatch):
    base = 0x9E3779B97F4A7C15 | 1
    text = "abcacbaéxyzzy"

    def keys(t):
        got = list(L._keys(t, base))
        return np.concatenate([k for k, _ in got]), np.concatenate([i for _, i in got])

    whole, at = keys(text)
    assert at.tolist() == list(range(-1, len(text)))
    for i in range(len(text)):
        assert whole[i + 1] == keys(text[:i] + text[i + 1 :])[0][0]
    for size in (1, 2, 5):
        monkeypatch.setattr(L, "VARIANTS", size)
        assert keys(text)[0].tolist() == whole.tolist()


def test_many_lines_in_one_document(spark):
    """Twice the lines take about twice the time: looking each up in a list took the square (80,000 lines did not end)."""

    def seconds(n):
        text = "\n".join("line %d of the log" % (i // 2) for i in range(n))
        df = spark.createDataFrame([(1, text)], SCHEMA)
        began = time.monotonic()
        assert L.dedup_lines(df).select(F.size(F.split("text", "\n"))).first()[0] == n // 2
        return time.monotonic() - began

    seconds(1000)
    assert seconds(300_000) < 60


def test_a_very_long_line(spark):
    x = "".join(chr(97 + (i * i) % 26) for i in range(300_000))
    assert run(spark, [(1, x), (2, x[:1000] + "!" + x[1000:]), (3, "other")]) == [(1, x), (3, "other")]


def test_repeats_ties_and_clashing_columns(spark):
    a, b = "the quick brown fox jumps over", "the quick brown fox jumped over it all"
    rows = [(1, f"{a}\n{b}", 1, 2, 3), (1, f"{a}\n{b}", 1, 2, 4), (2, f"{a}x\nmore", 1, 2, 5), (3, a, 1, 2, 6), (None, f"{b}\nlast", 1, 2, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, kept int, `a.b` int")
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted(((r[0], r[1], r[4]) for r in out.collect()), key=repr) == sorted([(1, f"{a}\n{b}", 3), (1, f"{a}\n{b}", 4), (2, "more", 5), (None, "last", 7)], key=repr)
    assert L.dedup_lines(df.limit(0)).count() == 0
