import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import lm_scoring as M
from lexigrid.llm.common import utf8

F32 = np.float32
DOCS = "doc_id long, text string"


def context(data, i, order):
    """The hash of the ``order`` bytes before byte ``i``, zeros before the start; up to two bytes as they are."""
    before = [data[i - k] if i >= k else 0 for k in range(1, order + 1)]
    if order <= 2:
        return sum(c << (8 * k) for k, c in enumerate(before))
    h = 0
    for c in before:
        h = (h + c + 1) * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x297A2D39 & 0xFFFFFFFF) >> (32 - M.HASH_BITS)


def visits(data, order):
    """How often each (context, node, bit) occurs."""
    out = Counter()
    for i, c in enumerate(data):
        h = context(data, i, order)
        for d in range(8):
            out[h, (1 << d) | (c >> (8 - d)), (c >> (7 - d)) & 1] += 1
    return out


def held(texts, order, bits):
    """The contexts that have their place in the table: the most frequent ones, of equals the least."""
    seen = Counter(context(t, i, order) for t in texts for i in range(len(t)))
    best = {}
    for h, n in seen.items():
        p = h & ((1 << bits) - 1)
        if p not in best or (n, -h) > (seen[best[p]], -best[p]):
            best[p] = h
    return set(best.values())


def reference(texts, orders, bits):
    """Bits of each text, one bit after the other."""
    total = [sum((visits(t, o) for t in texts), Counter()) for o in orders]
    kept = [held(texts, o, bits) for o in orders]
    out = []
    for data in texts:
        own = [visits(data, o) for o in orders]
        before = [Counter() for _ in orders]
        spent = 0.0
        for i, c in enumerate(data):
            if i % M.SEGMENT == 0:
                w = [[F32(M.START / M.SCALE)] * len(orders) for _ in range(8)]
                gain = [F32(1)] * (len(orders) + 1)
                cells = [list(M._CENTRES) for _ in range(8)]
            got = F32(1)
            for d in range(8):
                node, y = (1 << d) | (c >> (8 - d)), (c >> (7 - d)) & 1
                xs, level = [], 0
                for k, o in enumerate(orders):
                    h = context(data, i, o)
                    n = []
                    for bit in (0, 1):
                        whole = M.DECODED[M.encoded(np.array([total[k][h, node, bit]]))[0]] if h in kept[k] else F32(0)
                        n.append(max(F32(whole - F32(own[k][h, node, bit] - before[k][h, node, bit])) - F32(before[k][h, node, bit]), F32(0)))
                    share = F32(M.LIMIT) / max(n[0] + n[1], F32(M.LIMIT))
                    z, one = (F32(n[b] * share) + F32(before[k][h, node, b]) for b in (0, 1))
                    level += z + one > 0
                    x = np.rint(np.log((one + F32(M.PRIOR)) / (z + F32(M.PRIOR))) * F32(M.SCALE))
                    xs.append(F32(min(max(x, -127), 127)))
                    before[k][h, node, y] += 1
                s = sum((a * b for a, b in zip(w[d], xs)), F32(0))
                z = min(max(F32(s * gain[level]), F32(-M.MOST)), F32(M.MOST))
                cell = int(np.rint(z * F32(1 / M.MAP_STEP))) + M.CELLS // 2
                p = F32(1) / (F32(1) + np.exp(-z))
                m = cells[d][cell]
                q = p + (m - p) * F32(M.MAP_SHARE)
                got *= abs(q + F32(y) - F32(1))
                cells[d][cell] = m + (F32(y) - m) * F32(M.MAP_RATE)
                e = (F32(y) - p) * F32(M.RATE / M.SCALE)
                g = gain[level]
                gain[level] = g + e * s
                w[d] = [a + e * g * b for a, b in zip(w[d], xs)]
            spent -= math.log2(got)
        out.append(spent)
    return out


def tables(texts, orders, bits):
    t = M.Tables(orders, bits)
    for k, o in enumerate(orders):
        keep = held(texts, o, bits)
        counts = Counter((context(x, i, o), x[i]) for x in texts for i in range(len(x)))
        dense = np.zeros((1 << bits, 256), np.int64)
        for (h, c), n in counts.items():
            if h in keep:
                t.owner[k][h & int(t.mask)] = h
                dense[h & int(t.mask), c] = n
        t.counts[k][256:] = M.nodes(dense).ravel()
    return t


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "état", "lorem", "zzz", "a", "in", "token"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(10)]
    return texts + ["", "x", texts[3], "ab" * 300, "".join(chr(rng.randrange(32, 400)) for _ in range(M.SEGMENT + 200))]


def scored(texts, t):
    whole, off = utf8(pa.array(texts))
    return M.score_rows(whole, off, t)


@pytest.mark.parametrize("orders,bits", [((3, 5), 16), ((1, 2, 4), 8)])
def test_bits_are_those_of_a_coder_that_goes_bit_by_bit(orders, bits):
    texts = corpus()
    t = tables([x.encode() for x in texts], orders, bits)
    want = reference([x.encode() for x in texts], orders, bits)
    assert scored(texts, t) == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_batches_change_nothing(monkeypatch):
    texts = corpus(2)
    t = tables([x.encode() for x in texts], M.ORDERS, 12)
    want = scored(texts, t).tolist()
    assert [float(scored([x], t)[0]) for x in texts] == pytest.approx(want, rel=1e-6)
    monkeypatch.setattr(M, "SORT_BLOCK", 100)
    assert scored(texts, t).tolist() == pytest.approx(want, rel=1e-6)


def test_a_text_does_not_pay_for_itself_but_its_copy_does(spark):
    rng = random.Random(4)
    odd = "".join(rng.choice("abcdefghijklmnop") for _ in range(600))
    other = [(i, " ".join(rng.choice(["some", "plain", "words", "here"]) for _ in range(60))) for i in range(20)]

    def bits(rows):
        return {r["doc_id"]: r["total_bits"] for r in M.score(spark.createDataFrame(rows, DOCS)).collect()}

    alone = bits([(99, odd)])[99]
    beside = bits([*other, (99, odd)])[99]
    twice = bits([*other, (99, odd), (98, odd)])
    assert beside > 0.9 * alone and alone > 3 * 600
    assert twice[98] == twice[99] < 0.5 * beside


def test_spark_gathers_the_tables(spark):
    texts = corpus(3)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(99, None)], DOCS).repartition(4)
    t = M.train(df)
    data = [x.encode() for x in texts]
    size = sum(map(len, data))
    assert t.bits == max(M.LEAST_BITS, size.bit_length() - M.BYTES_BITS)
    want = tables(data, M.ORDERS, t.bits)
    for k in range(len(M.ORDERS)):
        assert np.array_equal(t.owner[k], want.owner[k]) and np.array_equal(t.counts[k], want.counts[k])
    rows = {r["doc_id"]: r for r in M.score(df).collect()}
    assert [rows[i]["total_bits"] for i in range(len(texts))] == pytest.approx(scored(texts, want).tolist(), rel=1e-6)
    assert rows[99]["n_bytes"] is None and rows[99]["total_bits"] is None


def test_awkward_rows(spark):
    df = spark.createDataFrame([(None, "abc", 1, 2), (1, "", 1, 2), (1, "", 1, 2), (2, None, 1, 2)], DOCS + ", k int, `a.b` int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["bits_per_byte"] is None) for r in M.score(df).collect()), key=repr)
    assert got == sorted([(None, 3, False), (1, 0, True), (1, 0, True), (2, None, True)], key=repr)
    assert M.score(df.limit(0)).count() == 0


def test_a_long_text_takes_time_in_proportion():
    text = "some words that come again and others %d " * 20_000
    t = M.Tables(M.ORDERS, 8)
    assert 0 < scored([text], t)[0] < 8 * len(text)


def test_counts_as_bytes():
    n = np.array([0, 1, 64, 65, 1000, 10**9, 1 << 50])
    got = M.DECODED[M.encoded(n)]
    assert got[:3].tolist() == [0, 1, 64] and np.all(np.abs(np.log(got[3:6] / n[3:6])) < 0.07)


def test_contexts_without_a_place_count_like_the_others(spark, monkeypatch):
    texts = corpus(3)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(99, None)], DOCS).repartition(3)
    data = [x.encode() for x in texts]
    want = reference(data, M.ORDERS, M.HASH_BITS)
    bits = max(M.LEAST_BITS, sum(map(len, data)).bit_length())
    assert max(abs(a - b) for a, b in zip(scored(texts, tables(data, M.ORDERS, bits)), want)) > 1
    for most in (M.MOST_BITS, 8):
        monkeypatch.setattr(M, "MOST_BITS", most)
        rows = {r["doc_id"]: r for r in M.score_all(df).collect()}
        assert len(rows) == len(texts) + 1
        assert [rows[i]["total_bits"] for i in range(len(texts))] == pytest.approx(want, rel=1e-4, abs=1e-6)
        assert rows[99]["n_bytes"] is None and rows[99]["total_bits"] is None


def test_awkward_rows_in_blocks(spark):
    df = spark.createDataFrame([(None, "abc", 1, 2), (1, "", 1, 2), (1, "", 1, 2), (2, None, 1, 2)], DOCS + ", k int, `block` int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["bits_per_byte"] is None) for r in M.score_all(df).collect()), key=repr)
    assert got == sorted([(None, 3, False), (1, 0, True), (1, 0, True), (2, None, True)], key=repr)
    assert M.score_all(df.limit(0)).count() == 0


def test_visits_of_long_groups_are_those_of_short_ones():
    rng = np.random.default_rng(5)
    length = np.array([2, 700, 31, 5, 2])
    first = np.cumsum(length) - length
    c = rng.integers(0, 256, length.sum()).astype(np.uint8)
    found = []
    for find in (M._visits, M._long_visits):
        at, before, whole = find(c, first, length)
        order = np.argsort(at)
        found.append((before[:-1].reshape(-1, 9)[order], whole[:-1].reshape(-1, 9)[order]))
    assert all(np.array_equal(a, b) for a, b in zip(*found))


def peak(f):
    """What ``f`` returns, and the most bytes that it took meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_answers_take_a_few_bytes_each_and_tell_the_ways_to_every_byte():
    rng = np.random.default_rng(6)
    h, byte = np.repeat(np.arange(1 << 12), 200), np.tile(np.arange(200), 1 << 12)
    n = rng.integers(1, 100, len(h))
    n[:200] = 70_000
    counts = pa.table({"k": np.zeros(len(h), np.int32), "h": h, "byte": byte.astype(np.int32), "n": n})
    asked = pa.table({"block": [7], "k": pa.array([0], pa.int32()), "h": [np.arange(0, 1 << 12, 2, dtype=np.uint32).tobytes()]})
    answers = M._answered(asked, counts)
    many = len(h) // 2
    assert answers.nbytes < 6 * many
    rest, most = peak(lambda: M._rest(answers, 1))
    assert most < 40 * many
    pairs = np.sort(rng.choice(1 << 20, 3000, replace=False)).astype(np.uint64)
    same, other = M._known(pairs, M.Tables((5,), 8), 0, rest)
    for q, a, b in zip(pairs.tolist(), same, other):
        x, c = q >> 8, q & 255
        mine = n.reshape(-1, 200)[x]
        if x % 2 or c >= 200:
            assert not a.any() and not b.any()
            continue
        for d in range(8):
            way, to = (np.arange(200) >> (8 - d)) == c >> (8 - d), (np.arange(200) >> (7 - d)) == c >> (7 - d)
            assert a[d] == M.DECODED[M.encoded(mine[to].sum())] and b[d] == M.DECODED[M.encoded(mine[way & ~to].sum())]


def test_a_block_takes_some_bytes_for_each_of_its_own():
    rng = np.random.default_rng(7)
    b = rng.integers(97, 117, 1 << 21).astype(np.uint8)
    offsets = np.arange(0, len(b) + 1, 1 << 11)
    t = M.Tables(M.ORDERS, 8)
    x, most = peak(lambda: M.evidence(b, offsets, t))
    assert most < 160 * len(b)
    part = slice(300 << 11, 301 << 11)
    assert np.array_equal(x[part], M.evidence(b[part], np.array([0, 1 << 11]), t))
