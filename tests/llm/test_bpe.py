import random
import time

import pyarrow as pa
import pytest
import tiktoken
from pyspark.errors import PythonException

from lexigrid.llm import bpe as B

RANKS = B.load_ranks()
TOKENS = B.token_bytes(RANKS)
DOCS = "doc_id long, text string"


def naive(piece, ranks=RANKS):
    """Merges the leftmost of the least-ranked pairs until there is none."""
    part = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in part]
        i = best[1]
        part[i : i + 2] = [part[i] + part[i + 1]]


def pieces(seed, n, longest):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice([b"ab", b"aeinrst", bytes(range(256)), b"the and ing", b"\xc3\xa9\xe2\x82", b"0"])
        yield bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, longest)))


@pytest.mark.parametrize("longest,n", [(12, 3000), (120, 200), (600, 12)])
def test_ids_are_those_of_naive_merging(longest, n):
    m = B.Merger(RANKS)
    for p in pieces(longest, n, longest):
        assert m.encode(p) == naive(p), p


def test_short_and_long_queues_agree(monkeypatch):
    m = B.Merger(RANKS)
    want = [m.encode(p) for p in pieces(7, 300, 250)]
    monkeypatch.setattr(B, "DENSE", 0)
    assert [m.encode(p) for p in pieces(7, 300, 250)] == want


def test_words_need_no_positions_in_buckets(monkeypatch):
    m = B.Merger(RANKS)
    words = [p for p in pieces(8, 2000, 49)]
    monkeypatch.setattr(m, "bits", None)
    got = [m.encode(p) for p in words]
    assert got == [naive(p) for p in words] and not any(m.leaves)


def test_a_pretoken_of_half_a_megabyte():
    m = B.Merger(RANKS)
    for unit in (b"a", b"ab", b"theing"):
        began = time.process_time()
        ids = m.encode(unit * (100_000 // len(unit)))
        assert b"".join(map(TOKENS.__getitem__, ids)) == unit * (100_000 // len(unit))
        assert time.process_time() - began < 40


def test_places_come_in_order():
    rng = random.Random(3)
    s, held = B._Places(3), set()
    for _ in range(20_000):
        if held and rng.random() < 0.5:
            least, last = s.pop()
            assert least == min(held)
            held.remove(least)
            assert last == (not held)
        elif (p := rng.choice([rng.randrange(300), rng.randrange(1 << 24)])) not in held:
            s.add(p)
            held.add(p)


def test_texts_have_the_ids_of_a_public_encoder():
    enc = tiktoken.Encoding("x", pat_str=B.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rng = random.Random(11)
    signs = ["a", "Bc", "é", "1", "²", " ", "  ", "\n", "\t", "'s", "'ll", "...", "\U0001f600", "\u3000", "\x1c", "word", "的"]
    cache = B._Pieces(RANKS)
    for _ in range(2000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert list(memoryview(B.encode_text(t, cache)).cast("i")) == enc.encode_ordinary(t)


def test_the_cache_keeps_its_bound(monkeypatch):
    monkeypatch.setattr(B, "CACHED", 20)
    cache = B._Pieces(RANKS)
    for i in range(500):
        assert cache[f"w{i % 37}"] == B._Pieces(RANKS)[f"w{i % 37}"]
        assert len(cache) <= 10 and len(cache.old) <= 10


def test_round_trip_and_awkward_rows(spark):
    texts = ["", None, "plain words", "\ud7ff\U0010ffff \x00 z", "x" * 100_000, "plain words"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], DOCS + ", token_ids int")
    out = B.encode(df)
    rows = {(r["doc_id"], r["n_tokens"], r["round_trip"]) for r in out.collect()}
    assert len(rows) == 6 and (None, 0, True) in rows and (1, None, None) in rows and all(r[2] is not False for r in rows)
    back = {(r["doc_id"], r["text"]) for r in B.decode(out).collect()}
    assert back == {(i if i else None, t) for i, t in enumerate(texts)}
    assert B.encode(df.limit(0)).count() == B.decode(out.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[-1, 0], [len(TOKENS)], [None]])
def test_ids_that_are_nobodys(spark, ids):
    with pytest.raises(ValueError):
        B.decode_ids(ids, TOKENS)
    with pytest.raises(PythonException):
        B.decode(spark.createDataFrame([(1, ids)], "doc_id long, token_ids array<int>")).collect()


def test_a_batch_takes_memory_of_its_blocks(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    monkeypatch.setattr(B, "BLOCK", 1 << 15)
    text = "some words of a text, one like the other " * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(401)), pa.array([None, *[text] * 400])], ["doc_id", "text"])
    run = B._encoder(SimpleNamespace(value=RANKS), "test", True)
    rows, first = 0, None
    list(run(iter([batch.slice(0, 2)])))
    tracemalloc.start()
    for out in run(iter([batch])):
        first = first or out.slice(0, 2).to_pylist()
        rows += out.num_rows
        assert all(out.column("round_trip").to_pylist()[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 401 and first[0]["token_ids"] is None and first[1]["token_ids"] == [i for p in B._find(text) for i in B.encode_piece(p.encode(), RANKS)]
    assert peak < len(text) * 400 // 2
