import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import decontaminate as D

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def body(text):
    return D.letters(pa.array([text], pa.string()))[0].tobytes()


def least_edits(pattern, text):
    """Of the pattern and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items, window=D.WINDOW, rate=D.RATE):
    found = set()
    for i, t in docs:
        if t is None:
            continue
        for item, x in items:
            best, seen = None, set()
            for _, piece, whole in D.windows_of(item, x, window) if x is not None else []:
                if whole:
                    ok, e = body(t) == piece, 0
                else:
                    e = least_edits(piece, body(t))
                    ok = e <= min(int(rate * len(piece) + 1e-9), (len(piece) - D.Q) // D.Q)
                if ok:
                    seen.add(piece)
                    best = e if best is None else min(best, e)
            if seen:
                found.add((i, item, len(seen), best))
    return found


def scan(docs, items, rows=1 << 20, **more):
    windows = [w for i, t in items if t is not None for w in D.windows_of(i, t)]
    index = D.Index(windows)
    best = {}
    for at in range(0, len(docs), rows):
        part = docs[at : at + rows]
        for row, owners, name, edits, end in D._hits(index, pa.array([t for _, t in part], pa.string())):
            for item in owners:
                w, e = best.get((part[row][0], item), (set(), edits))
                best[part[row][0], item] = w | {name}, min(e, edits)
    return {(d, i, len(w), e) for (d, i), (w, e) in best.items()}


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            t.insert(k, rng.choice("abcxyz"))
        elif t and k < len(t):
            t[k : k + 1] = [] if kind == 1 else [rng.choice("abcxyz")]
    return "".join(t)


def world(seed, letters="abcdefghij", plants=60):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, word(rng.choice([3, 7, 8, 9, 12, 20, 40, 64, 65, 90, 130]))) for i in range(25)] + [(98, None), (99, ""), (97, "..!")]
    docs = []
    for i in range(plants):
        x = rng.choice(items[:25])[1]
        docs.append((i, word(rng.randrange(0, 30)) + edited(rng, x, rng.randrange(0, 8)) + word(rng.randrange(0, 30))))
        docs += [(1000 + i * 3 + k, rng.choice(["", "a", "ab", word(3), word(rng.randrange(0, 80))])) for k in range(rng.randrange(0, 3))]
    return docs, items


@pytest.mark.parametrize("seed,letters", [(1, "abcdefghij"), (2, "ab"), (3, "abc"), (4, "abcdefghijklmnopqrstuvwxyz")])
def test_finds_what_full_tables_find_whatever_the_batch(seed, letters):
    docs, items = world(seed, letters)
    want = brute(docs, items)
    assert len(want) > 20
    assert scan(docs, items) == want
    for rows in (1, 2, 7):
        assert scan(docs, items, rows) == want


def test_short_items_beside_short_rows():
    long = "q" + "wertzuiopasdfgh" * 9
    items = [(1, "abcdefgh"), (2, long), (3, "yes")]
    docs = [(0, "abcdefgh"), (1, ""), (2, ""), (3, "z" * 80), (4, "Yes!"), (5, "yes or no"), (6, "..")]
    assert scan(docs, items) == {(0, 1, 1, 0), (4, 3, 1, 0)} == brute(docs, items)


def test_long_rows_are_looked_at_in_stretches(monkeypatch):
    docs, items = world(5)
    long = [(0, "".join(t for _, t in docs)), (1, "x"), (2, "".join(t for _, t in reversed(docs)))]
    want = scan(long, items)
    monkeypatch.setattr(D, "BLOCK", 257)
    monkeypatch.setattr(D, "EXPAND", 50)
    assert scan(long, items) == want == brute(long, items)


def test_runs_of_one_letter_take_bounded_memory():
    import tracemalloc

    items = [(i, "ab%03d" % i + "0" * (60 + i % 40) + "cd") for i in range(300)]
    windows = [w for i, t in items for w in D.windows_of(i, t)]
    index = D.Index(windows)
    tracemalloc.start()
    hits = list(D._hits(index, pa.array(["0" * 4096])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits and peak < 150 << 20


def test_a_batch_takes_memory_of_its_blocks():
    import tracemalloc

    docs, items = world(7)
    index = D.Index([w for i, t in items if t is not None for w in D.windows_of(i, t)])
    texts = [None, "".join(t for _, t in docs)[:2000], "", "z" * 2000]
    one = sorted(D._hits(index, pa.array(texts)), key=repr)
    column = pa.array(texts * 4000)
    tracemalloc.start()
    hits = list(D._hits(index, column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert one and sorted((h for h in hits if h[0] < 4), key=repr) == one
    assert sorted(((h[0] - 15996, *h[1:]) for h in hits if h[0] >= 15996), key=repr) == one
    assert len(hits) == 4000 * len(one) and peak < 4 * 4000 * 4000


def test_spark_parts_and_whole_rows(spark):
    docs, items = world(6)
    docs += [(None, docs[0][1]), (None, docs[0][1]), (7, None), docs[1], docs[1]]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = sorted(map(tuple, D.contamination(df, bench).select("doc_id", "item_id", "windows", "edits").collect()), key=repr)
    many = sorted(map(tuple, D.contamination(df, bench, most=7).select("doc_id", "item_id", "windows", "edits").collect()), key=repr)
    want = []
    for d in docs:
        want += [x for x in brute([d], items)]
    assert one == many == sorted(want, key=repr)
    bad = {t for _, t in docs if t is not None and brute([(0, t)], items)}
    for most in (D.WINDOWS, 7):
        left = sorted(map(tuple, D.drop_contaminated(df, bench, most=most).collect()), key=repr)
        assert left == sorted((d for d in docs if d[1] not in bad), key=repr)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "abcdefghijkl")], DOCS), spark.createDataFrame([], ITEMS)
    assert D.contamination(docs, none).count() == 0 and D.drop_contaminated(docs, none).count() == 1
    assert D.contamination(docs.limit(0), none).count() == D.drop_contaminated(docs.limit(0), none).count() == 0
    assert np.array_equal(D.Index([]).lengths, [])
