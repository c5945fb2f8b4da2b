"""Near-duplicate groups by MinHash with tensored banding.

A document is the set of its word 3-grams (lower case). Two collections of
``m`` sub-keys, each of ``r`` minhashes, are computed; the table keys are all
``m * m`` pairs of a sub-key of the one and a sub-key of the other. So
``2 * m * r`` minhashes serve ``m * m`` tables of ``2 * r`` hashes each. Documents that share a
table key are candidates, and exact Jaccard similarity of their sets
decides.

Documents with equal sets are one node (two 64-bit sums over the set tell sets apart). A
bucket's nodes are first compared with one centre of the bucket, the least node; nodes so
joined need no further comparison between them. Buckets whose nodes are still in several
groups get ``ROUNDS`` further centres, and what pairs of different groups are left in them are
then compared one by one. Hence groups are exactly the connected components of
the candidate pairs with similarity of at least ``threshold``, though large groups cost
about one comparison a member. No bucket is ever held in one row: centres come from
aggregates, and pairs from joins that Spark may split.

Similarity is that of the sets of 32-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import GOLDEN, U64, beside, id_of, mix, packed, row_key, runs, unpacked, utf8, words
from lexigrid.operators.components import connected_components
from lexigrid.shipping import map_arrow
from lexigrid.storage import discard, materialise

THRESHOLD = 0.5
TABLES = 11
HASHES = 2
GRAM = 3
ROUNDS = 2
BLOCK = 1 << 20
#: About so many table keys are made, and aggregated before the shuffle, by one task.
TASK_KEYS = 1 << 20


def shingle_sets(column: pa.Array, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges ``i:j`` the sorted distinct 32-bit shingles, end to end, and the offset of each row.

    A text of fewer than ``gram`` words has one shingle of all of them; a text without words has none.
    """
    whole, offsets = utf8(pc.utf8_lower(column))
    for i, j in runs(offsets, BLOCK):
        b, off = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, _, h = words(b, off)
        row = np.searchsorted(off, starts, "right") - 1
        n_words = np.bincount(row, minlength=j - i)
        first = np.concatenate(([0], np.cumsum(n_words)))
        grams = np.maximum(np.minimum(n_words, 1), n_words - gram + 1)
        g_off = np.concatenate(([0], np.cumsum(grams)))
        g_row = np.repeat(np.arange(j - i), grams)
        at = np.arange(g_off[-1]) - g_off[g_row] + first[g_row]
        x = np.zeros(len(at), dtype=U64)
        for k in range(gram):
            inside = at + k < first[g_row + 1]
            x = x * GOLDEN + np.where(inside, h[np.minimum(at + k, max(0, len(h) - 1))] if len(h) else U64(0), U64(k + 1))
        x = (g_row.astype(U64) << U64(32)) | (mix(x) >> U64(32))
        x.sort()
        if len(x):
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        row = (x >> U64(32)).astype(np.int64)
        yield i, j, (x & U64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(row, np.arange(j - i + 1))


def _fingerprint(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit name of each set (rows without shingles excluded), and another one that tells sets of one name apart."""
    n = np.diff(off).astype(U64) * GOLDEN
    x = mix(sets.astype(U64) + GOLDEN)
    return mix(np.add.reduceat(x, off[:-1]) + n), mix(np.add.reduceat(mix(x + GOLDEN), off[:-1]) + n)


def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7_700_417)
    return rng.integers(1, 1 << 63, count, dtype=U64) | U64(1), rng.integers(1, 1 << 63, count, dtype=U64)


def sub_keys(sets: np.ndarray, off: np.ndarray, m: int, r: int) -> np.ndarray:
    """``(rows, 2, m)`` sub-keys: each is the hash of ``r`` minhashes."""
    a, c = _hashers(2 * m * r)
    x, starts = sets.astype(U64), off[:-1]
    out = np.zeros((len(starts), 2 * m), dtype=U64)
    for k in range(2 * m):
        for q in range(r):
            low = np.minimum.reduceat((x * a[k * r + q] + c[k * r + q]) >> U64(32), starts)
            out[:, k] = mix(out[:, k] * GOLDEN + low + U64(k + 1))
    return out.reshape(-1, 2, m)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signatures(m: int, r: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, off in shingle_sets(batch.column("text"), gram):
                full = np.flatnonzero(np.diff(off) > 0)
                if not len(full):
                    continue
                off = np.append(off[full], len(sets))
                keys = sub_keys(sets, off, m, r).reshape(len(full), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * m), pa.int32()), _signed(keys.ravel()))
                take = pa.array(full + i)
                sid, other = map(_signed, _fingerprint(sets, off))
                yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("h").take(take), sid, other, lists], ["d", "h", "sid", "other", "keys"])

    return run


def _table_keys(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, m * m + 1).astype(U64)).reshape(m, m)
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(U64).reshape(-1, 2, m)
            sid = batch.column("sid").to_numpy(zero_copy_only=False)
            for i in range(0, len(sid), 2048):
                part = keys[i : i + 2048]
                pairs = mix(part[:, 0, :, None] * GOLDEN + part[:, 1, None, :] + salt)
                yield pa.RecordBatch.from_arrays([_signed(pairs.ravel()), pa.array(np.repeat(sid[i : i + 2048], m * m))], ["bk", "sid"])

    return run


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, sets, off in shingle_sets(batch.column("text"), gram):
                full = np.flatnonzero(np.diff(off) > 0)
                if len(full):
                    off = np.append(off[full], len(sets))
                    data = pa.py_buffer(np.ascontiguousarray(sets))
                    bodies = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer((off * 4).astype(np.int64)), data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(full + i)), bodies], ["sid", "body"])

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
    return both / (len(x) + len(y) - both)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("xb"), batch.column("yb")
            ok = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(c[k].as_buffer(), np.uint32) for c in (xs, ys))
                small, large = (len(x), len(y)) if len(x) < len(y) else (len(y), len(x))
                ok.append(small >= threshold * large and jaccard(x, y) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(ok)), batch.column("y").filter(pa.array(ok))], ["x", "y"])

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, m: int = TABLES, r: int = HASHES, gram: int = GRAM) -> DataFrame:
    """``(d, h, lead)`` of every document key with shingles that belongs to a group of two keys or more; ``lead`` is the group's least key."""
    rows = docs.select(row_key().alias("k"), "text").select("k.d", "k.h", "text")
    signed = materialise(map_arrow(rows, _signatures(m, r, gram), "d long, h long, sid long, other long, keys array<long>"), "sig")
    # different sets under one name (some hundred among 10^11) get names of their own
    clash = materialise(signed.groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("sid", "lo"), "clash")
    if not clash.isEmpty():
        apart = signed.join(beside(clash), "sid", "left").withColumn("sid", F.when(F.col("other") != F.col("lo"), F.xxhash64("sid", "other")).otherwise(F.col("sid")))
        signed, before = materialise(apart.drop("lo"), "sig"), signed
        discard(before)
    nodes = materialise(signed.groupBy("sid").agg(F.first("keys").alias("keys"), F.min(F.struct("d", "h")).alias("k")), "nodes")
    # a node is small but has m * m table keys: tasks are sized by those
    spread = nodes.select("sid", "keys").repartition(1 + nodes.count() * m * m // TASK_KEYS, "sid")
    tables = map_arrow(spread, _table_keys(m), "bk long, sid long")
    met = tables.groupBy("bk").agg(F.min("sid").alias("lo"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x")).where("n > 1")
    # tables that hold the very same nodes need to be looked at once
    met = materialise(met.groupBy("lo", "n", "x").agg(F.min("bk").alias("bk")).select("bk", "lo"), "met")
    members = materialise(tables.join(beside(met, 24), "bk").select("bk", "sid", "lo"), "members")
    stars = materialise(members.where("sid <> lo").select(F.col("lo").alias("x"), F.col("sid").alias("y")).distinct(), "stars")

    need = members.select("sid").distinct()
    chosen = nodes.join(need, "sid", "left_semi").select("k.d", "k.h", F.col("sid"))
    chosen = beside(materialise(chosen, "chosen"), 32)
    # a key may repeat: one row of it gives the set
    bodies = map_arrow(rows.join(chosen, ["d", "h"]).select("sid", "text"), _sets(gram), "sid long, body binary")
    bodies = materialise(bodies.groupBy("sid").agg(F.first("body").alias("body")), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        one = pairs.join(bodies.select(F.col("sid").alias("x"), F.col("body").alias("xb")), "x")
        two = one.join(bodies.select(F.col("sid").alias("y"), F.col("body").alias("yb")), "y")
        # sets whose sizes are too far apart cannot be similar enough
        fits = F.least(F.length("xb"), F.length("yb")) >= F.lit(threshold) * F.greatest(F.length("xb"), F.length("yb"))
        return map_arrow(two.where(fits).select("x", "y", "xb", "yb"), _verify(threshold), "x long, y long")

    near = materialise(check(stars), "near")
    label = materialise(connected_components(near, "x", "y"), "labels")
    done = stars
    for turn in range(ROUNDS + 1):
        # the nodes of buckets that are in several groups still
        named = members.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("bk", "sid", F.coalesce("component", "sid").alias("c"))
        mixed = named.groupBy("bk").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.min(F.struct(F.xxhash64("sid", F.lit(turn)), F.col("sid"), F.col("c"))).alias("e")).where("c_lo <> c_hi")
        left = materialise(named.join(mixed.select("bk", F.col("e.sid").alias("centre"), F.col("e.c").alias("centre_c")), "bk"), "mixed")
        if left.isEmpty():
            discard(left)
            break
        if turn < ROUNDS:
            pairs = left.where("c <> centre_c").select(F.least("sid", "centre").alias("x"), F.greatest("sid", "centre").alias("y"))
        else:
            one, two = left.select("bk", F.col("sid").alias("x"), F.col("c").alias("xc")), left.select("bk", F.col("sid").alias("y"), F.col("c").alias("yc"))
            pairs = one.join(two, "bk").where("x < y AND xc <> yc").select("x", "y")
        pairs = materialise(pairs.distinct().join(done, ["x", "y"], "left_anti"), "stars")
        more = materialise(check(pairs), "near")
        done = done.unionByName(pairs)
        discard(left)
        if not more.isEmpty():
            near = near.unionByName(more)
            discard(label)
            label = materialise(connected_components(near, "x", "y"), "labels")
    discard(clash, nodes, met, members, stars, bodies, near)

    named = signed.select("d", "h", "sid").join(label.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.select("d", "h", F.coalesce("component", "sid").alias("c")).distinct()
    lead = named.groupBy("c").agg(F.min(F.struct("d", "h")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "lead")
    return named.join(lead, "c").select("d", "h", "lead")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, m: int = TABLES, r: int = HASHES, gram: int = GRAM) -> DataFrame:
    """``(doc_id, near_copy_of)`` for every document of a group but its first one.

    The first one is the least key of the group (doc_id ascending, null last).
    Documents outside any group, and those whose text is null or has no words,
    do not appear. Rows that repeat doc_id and text are one document. Blanks
    are the bytes up to U+0020; case does not matter. An empty table gives no rows. Long texts count
    whole; of extra columns none is read. A pair at the very threshold shares a
    table with probability 0.917, at 0.6 with 0.98.
    """
    g = near_groups(docs, threshold, m, r, gram).where("d <> lead.d OR h <> lead.h")
    return g.select(id_of(F.col("d")).alias("doc_id"), id_of(F.col("lead.d")).alias("near_copy_of"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, m: int = TABLES, r: int = HASHES, gram: int = GRAM) -> DataFrame:
    """``docs`` without all but the first document of each group; all columns stay.

    Of rows that repeat doc_id and text every one stays or goes with its document. Texts that are null, empty or
    without words stay, as does a null doc_id whose text is nobody's copy; an empty table stays empty. Extra columns
    are carried, whatever their names.
    """
    gone = materialise(near_groups(docs, threshold, m, r, gram).where("d <> lead.d OR h <> lead.h").select("d", "h"), "gone")
    gone = beside(gone)
    rows = packed(docs).withColumn("k", row_key(F.col("r.doc_id"), F.col("r.text")))
    return unpacked(rows.join(gone, (F.col("k.d") == gone.d) & (F.col("k.h") == gone.h), "left_anti"))
