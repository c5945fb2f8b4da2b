"""LM scoring by online logistic context mixing.

A text is predicted bit by bit. Several predictors each look at a hashed
context of preceding bytes and tell the odds of the next bit at its node of the byte's
binary tree. What a predictor knows are visits to the node: those of the rest of the corpus,
and those of the text at hand up to this very bit. So predictors learn online, and
no text pays for itself: its own visits are taken out of the corpus' counts before it is read and come
back one by one. The odds are combined by weights that one gate picks (the bit's place in the byte), times a gain that another one
picks (in how many contexts the node was seen before), an adaptive probability map refines the
result, and the bits that coding would take are added up. Weights and map learn after every bit.

Long texts are read in segments of ``SEGMENT`` bytes: contexts and visits run on through the whole
text, weights and map start afresh in each segment. So segments can be
coded side by side, one bit of each at a time, and neither the batch nor the
length of a text changes what a segment takes.

The counts of all contexts of the corpus are gathered by Spark. Executors hold the contexts that fit into
tables of ``2^bits`` contexts an order, ``bits`` following the size of the corpus up to
``MOST_BITS``: where several contexts share a place the most frequent one has it, and a check
tells it from the others. Counts of those are joined to the blocks of rows that have them.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import U64, runs, utf8
from lexigrid.shipping import map_arrow, release
from lexigrid.storage import discard, materialise

ORDERS = (3, 5)
LEAST_BITS, MOST_BITS = 8, 16
#: Places of a table: one for each so many bytes of corpus, as a power of two.
BYTES_BITS = 0
PER_BLOCK = 16
HASH_BITS = 31
SCALE = 12.0
PRIOR = 0.4
#: The corpus counts for so many visits of a node at most: then the text at hand soon matters.
LIMIT = 64.0
START = 0.5
RATE = 0.02
CELLS = 33
MAP_STEP = 0.5
MOST = CELLS // 2 * MAP_STEP
MAP_RATE = 0.02
MAP_SHARE = 0.5
SEGMENT = 1 << 10
COUNT_BLOCK = 1 << 21
SCORE_BLOCK = 1 << 21
#: Contexts are looked up for so many bytes of a block at a time: what that takes beside the result does not follow the block.
LOOKUP_BLOCK = 1 << 19
SORT_BLOCK = 1 << 17
ODDS_BLOCK = 1 << 12
#: Groups of more positions are not read side by side: few are as long.
MOST_STEPS = 1 << 11

F32 = np.float32
#: Counts are held in a byte: exactly up to 64, then in steps of 12 percent.
_EXACT = 64
_GROW = np.log(2.0**40 / _EXACT) / (255 - _EXACT)
DECODED = np.concatenate((np.arange(_EXACT + 1), _EXACT * np.exp(_GROW * np.arange(1, 256 - _EXACT)))).astype(F32)


def _codes(n: np.ndarray) -> np.ndarray:
    more = _EXACT + np.rint(np.log(np.maximum(n, _EXACT) / _EXACT) / _GROW)
    return np.where(n <= _EXACT, n, np.minimum(more, 255)).astype(np.uint8)


_CODES = _codes(np.arange(1 << 16))


def encoded(n: np.ndarray) -> np.ndarray:
    """Counts as bytes; ``DECODED`` gives them back."""
    return _CODES.take(n) if n.size and int(n.max()) < len(_CODES) else _codes(n)


def contexts(b: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
    """For each order, the context of each byte: the bytes before it, zeros before the start of a row. Orders 1 and 2 as they are, others hashed."""
    some = np.diff(offsets) > 0
    starts, stops = offsets[:-1][some], offsets[1:][some]
    h = np.zeros(len(b), np.uint32)
    plain = np.zeros(len(b), np.uint32)
    out = []
    for k in range(1, max(orders) + 1):
        before = np.zeros(len(b), np.uint32)
        before[k:] = b[:-k]
        for d in range(k):
            edge = starts + d
            before[edge[edge < stops]] = 0
        if k <= 2:
            plain |= before << np.uint32(8 * (k - 1))
        h += before
        h += np.uint32(1)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
        if k in orders:
            out.append(plain.copy() if k <= 2 else (h * np.uint32(0x297A2D39)) >> np.uint32(32 - HASH_BITS))
    return out


class Tables:
    """For each order: the context that has each place (-1: none), and how often its nodes were left by a zero (low byte) and by a one (high byte).

    Counts start with a block for contexts that have no place: all zeros.
    """

    def __init__(self, orders: tuple[int, ...], bits: int) -> None:
        self.orders, self.bits = orders, bits
        self.mask = np.uint32((1 << bits) - 1)
        self.owner = [np.full(1 << bits, -1, np.int64) for _ in orders]
        self.counts = [np.zeros(((1 << bits) + 1) << 8, np.uint16) for _ in orders]


def nodes(counts: np.ndarray) -> np.ndarray:
    """``(contexts, 256)`` byte counts to encoded counts of each tree node's zeros and ones (node 0 is unused)."""
    out = np.zeros(counts.shape, np.uint16)
    level = counts.astype(np.int64)
    for d in range(7, -1, -1):
        pair = level.reshape(len(counts), 1 << d, 2)
        zero, one = encoded(pair[:, :, 0]).astype(np.uint16), encoded(pair[:, :, 1]).astype(np.uint16)
        out[:, 1 << d : 2 << d] = zero | one << np.uint16(8)
        level = pair.sum(axis=2)
    return out


def _gather(orders: tuple[int, ...]):
    """Counts of ``(order, context, byte)``, summed over some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = utf8(batch.column("text"))
            for i, j in runs(offsets, COUNT_BLOCK):
                b, off = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for k, h in enumerate(contexts(b, off, orders)):
                    key = (h.astype(np.int64) << 8) | b
                    key.sort()
                    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
                    n = np.diff(np.append(first, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array((key[first] << 3) | k), pa.array(n)], ["c", "n"])

    return run


def _counted(docs: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """``(k, h, byte, n)``: how often each byte follows each context, however many there are; a written table."""
    counts = map_arrow(docs.where("text IS NOT NULL").select("text"), _gather(orders), "c long, n long")
    return materialise(counts.groupBy("c").agg(F.sum("n").alias("n")).select(F.expr("CAST(c & 7 AS INT)").alias("k"), F.expr("shiftright(c, 11)").alias("h"), F.expr("CAST(shiftright(c, 3) & 255 AS INT)").alias("byte"), "n"), "counts")


def train(docs: DataFrame, orders: tuple[int, ...] = ORDERS) -> Tables:
    """Tables of the counts of every document."""
    counts = _counted(docs, orders)
    tables = _held(counts, orders)
    discard(counts)
    return tables


def _held(counts: DataFrame, orders: tuple[int, ...]) -> Tables:
    """Counts of the contexts that have a place: for each place the one with the most bytes.

    Spark chooses them, and executors turn their counts into those of nodes. So tables of bounded size are all that reaches the driver.
    """
    size = counts.where("k = 0").agg(F.sum("n")).first()[0] or 0
    bits = min(max(int(size).bit_length() - BYTES_BITS, LEAST_BITS), MOST_BITS)
    tables = Tables(orders, bits)
    place = F.expr(f"CAST(h & {(1 << bits) - 1} AS INT)")
    owners = counts.groupBy("k", "h").agg(F.sum("n").alias("n")).groupBy("k", place.alias("place")).agg(F.max(F.struct("n", -F.col("h"))).alias("m")).select("k", "place", (-F.col("m.col2")).alias("h"))

    def block(key: tuple, t: pa.Table) -> pa.Table:
        dense = np.zeros((PER_BLOCK, 256), np.int64)
        owner = np.full(PER_BLOCK, -1, np.int64)
        at = t["place"].to_numpy() % PER_BLOCK
        owner[at] = t["h"].to_numpy()
        dense[at, t["byte"].to_numpy()] = t["n"].to_numpy()
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "owner": pa.array([owner.tobytes()], pa.binary()), "body": pa.array([nodes(dense).tobytes()], pa.binary())})

    # owners are as many as the tables have places: a bound that the data do not move
    held = counts.join(F.broadcast(owners), ["k", "h"]).select("k", "place", "h", "byte", "n")
    blocks = held.groupBy("k", F.expr(f"place DIV {PER_BLOCK}").cast("int").alias("block")).applyInArrow(block, "k int, block int, owner binary, body binary")
    for r in blocks.toLocalIterator():
        at = r["block"] * PER_BLOCK
        tables.owner[r["k"]][at : at + PER_BLOCK] = np.frombuffer(r["owner"], np.int64)
        tables.counts[r["k"]][(at + 1) << 8 : (at + 1 + PER_BLOCK) << 8] = np.frombuffer(r["body"], np.uint16)
    return tables


_byte = np.arange(256)
_bits = np.stack([(_byte >> (7 - d)) & 1 for d in range(8)])
#: Nodes of the byte's tree at each of its bits; the bits; their signs, eight to a word.
NODES = np.stack([(1 << d) | (_byte >> (8 - d)) for d in range(8)], axis=1)
NODE_BITS = _bits.astype(F32)
SIGNS = np.ascontiguousarray(2 * _bits.T - 1).astype(np.int8).view(U64).ravel()
_pair = np.arange(1 << 16)
#: Counts of a table's word by the bit that comes: those of the same bit, and of the other one.
SAME = np.concatenate((DECODED[_pair & 255], DECODED[_pair >> 8]))
OTHER = np.concatenate((DECODED[_pair >> 8], DECODED[_pair & 255]))
BITS_HIGH = np.ascontiguousarray(_bits.T << 16)
#: Bits of a position in a sort key beside a context and its byte.
POSITION_BITS = 64 - HASH_BITS - 8


def _odds(same, other, own_same, own_other, same_before, other_before) -> tuple[np.ndarray, np.ndarray]:
    """Scaled log odds of the bit that comes, and whether anything is known, from the corpus' visits without the text's own, and the text's before.

    ``same`` and ``other`` are overwritten.
    """
    same -= own_same
    np.maximum(same, F32(0), out=same)
    other -= own_other
    np.maximum(other, F32(0), out=other)
    share = same + other
    np.maximum(share, F32(LIMIT), out=share)
    np.divide(F32(LIMIT), share, out=share)
    same *= share
    other *= share
    same += same_before
    other += other_before
    known = (same + other > 0).view(np.int8)
    same += F32(PRIOR)
    other += F32(PRIOR)
    same /= other
    np.log(same, out=same)
    same *= F32(SCALE)
    np.rint(same, out=same)
    np.clip(same, F32(-127), F32(127), out=same)
    return same.astype(np.int8), known


def _words(x: np.ndarray) -> np.ndarray:
    """Rows of nine bytes, the ninth left out, as words."""
    return np.ascontiguousarray(x.reshape(-1, 9)[:, :8]).view(U64).ravel()


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return np.flatnonzero(first)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and which of them each position has. Keys leave ``POSITION_BITS`` bits of a word free."""
    if len(key) >> POSITION_BITS:
        return np.unique(key, return_inverse=True)
    word = key << U64(POSITION_BITS)
    word |= np.arange(len(key), dtype=U64)
    word.sort()
    at = (word & U64((1 << POSITION_BITS) - 1)).view(np.int64)
    word >>= U64(POSITION_BITS)
    first = _starts(word)
    which = np.empty(len(key), np.int64)
    which[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return word.take(first), which


class Rest:
    """Counts of one order's contexts that have no place in the tables: ``context << 8 | byte``, sorted, and how often.

    Counts of nodes are made for the pairs that are looked up only.
    """

    def __init__(self, pairs: np.ndarray, n: np.ndarray) -> None:
        # a block that was read in two batches asked twice
        if len(pairs) and not (pairs[1:] > pairs[:-1]).all():
            pairs, first = np.unique(pairs, return_index=True)
            n = n[first]
        self.pairs, self.n = pairs, n

    def known(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``pairs`` (sorted) are here, and the columns of ``_known`` for those."""
        h = pairs >> U64(8)
        h = h[_starts(h)] << U64(8)
        first = np.searchsorted(self.pairs, h)
        at = _side_by_side(first, np.searchsorted(self.pairs, h + U64(256)) - first)[0]
        mine, n = self.pairs[at], self.n[at].astype(np.int64)
        if not len(mine):
            return np.zeros(0, np.int64), *np.zeros((2, 0, 9), F32)
        at = np.minimum(np.searchsorted(mine, pairs), len(mine) - 1)
        found = np.flatnonzero(mine[at] == pairs)
        at = at[found]
        same, other = np.zeros((2, len(at), 9), F32)
        above = None
        for d in range(9):
            first = _starts(mine >> U64(8 - d))
            here = np.add.reduceat(n, first).take(np.searchsorted(first, at, "right") - 1)
            if d:
                same[:, d - 1], other[:, d - 1] = DECODED.take(encoded(here)), DECODED.take(encoded(above - here))
            above = here
        return found, same, other


def _known(pairs: np.ndarray, tables: Tables, k: int, rest: list[Rest] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(pairs, 9)``: how often the corpus left each node on the way to a context's byte by the same bit, and by the other one; a column of zeros."""
    h, c = (pairs >> U64(8)).view(np.int64), (pairs & U64(255)).view(np.int64)
    place = h & int(tables.mask)
    held = tables.owner[k].take(place) == h
    base = np.where(held, (place + 1) << 8, 0)
    code = tables.counts[k].take(base[:, None] + NODES.take(c, axis=0)) + BITS_HIGH.take(c, axis=0)
    same, other = np.zeros((2, len(pairs), 9), F32)
    same[:, :8], other[:, :8] = SAME.take(code), OTHER.take(code)
    if rest is not None and len(rest[k].pairs):
        more = np.flatnonzero(~held)
        if len(more):
            found, *columns = rest[k].known(pairs[more])
            same[more[found]], other[more[found]] = columns
    return same, other


def evidence(b: np.ndarray, offsets: np.ndarray, tables: Tables, rest: list[Rest] | None = None) -> np.ndarray:
    """``(bytes, 8 * (orders + 1))``: by each order the scaled log odds of a one for each bit, then how many orders had been at each bit's node before.

    What the corpus knows is looked up once for each distinct context and byte of ``LOOKUP_BLOCK`` bytes. To a position whose context its row
    has nowhere else that is all there is; the others are grouped by row and context, and visits of each node are counted in the group.
    """
    out = np.zeros((len(b), len(tables.orders) + 1), U64)
    for i, j in runs(offsets, LOOKUP_BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi > lo:
            _looked_up(b[lo:hi], offsets[i : j + 1] - lo, tables, rest, out[lo:hi])
    return out.view(np.int8)


def _looked_up(b, offsets, tables, rest, out) -> None:
    many = len(tables.orders)
    signs = SIGNS.take(b)
    for k, h in enumerate(contexts(b, offsets, tables.orders)):
        pairs, which = _distinct((h.astype(U64) << U64(8)) | b)
        same, other = _known(pairs, tables, k, rest)
        odds, known = _odds(same.copy(), other.copy(), F32(1), F32(0), F32(0), F32(0))
        odds, known = _words(odds).take(which), _words(known).take(which)
        for i, j in runs(offsets, SORT_BLOCK):
            lo, hi = int(offsets[i]), int(offsets[j])
            if hi > lo:
                _shared(b[lo:hi], h[lo:hi], offsets[i : j + 1] - lo, same, other, which[lo:hi], odds[lo:hi], known[lo:hi])
        out[:, k] = (odds.view(np.int8) * signs.view(np.int8)).view(U64)
        out[:, many] += known


def _shared(b, h, offsets, same, other, which, odds, known) -> None:
    """Put right the odds at positions whose context their row has elsewhere, too."""
    size = len(b)
    pos_bits = U64(size.bit_length())
    key = np.repeat(np.arange(len(offsets) - 1, dtype=U64), np.diff(offsets)) << U64(HASH_BITS)
    key |= h
    key <<= pos_bits
    key |= np.arange(size, dtype=U64)
    key.sort()
    order = (key & ((U64(1) << pos_bits) - U64(1))).view(np.int64)
    key >>= pos_bits
    first = _starts(key)
    length = np.diff(np.append(first, size))
    order = order[np.repeat(length > 1, length)]
    if not len(order):
        return
    length = length[length > 1]
    first = np.cumsum(length) - length
    c = b.take(order)
    mixed = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    # where all of a group go the same way, each node's visits are the group's
    for one, many in _slices(first[~mixed], length[~mixed], ODDS_BLOCK):
        at, rank = _side_by_side(one, many)
        _put(order.take(at), which, same, other, np.repeat(np.repeat(many, many).astype(F32), 9), F32(0), np.repeat(rank.astype(F32), 9), F32(0), odds, known)
    for one, many in _slices(first[mixed], length[mixed], SORT_BLOCK):
        for find, some in ((_visits, many <= MOST_STEPS), (_long_visits, many > MOST_STEPS)):
            at, before, whole = find(c, one[some], many[some])
            for i in range(0, len(at), ODDS_BLOCK):
                j = min(i + ODDS_BLOCK, len(at))
                r, w = before[9 * i : 9 * j + 1], whole[9 * i : 9 * j + 1]
                # each column beside the next one; what the last one of a row meets is left out in the end
                _put(order.take(at[i:j]), which, same, other, w[1:], w[:-1] - w[1:], r[1:], np.maximum(r[:-1] - r[1:], F32(0)), odds, known)


def _put(to, which, same, other, own_same, own_other, same_before, other_before, odds, known) -> None:
    v = which.take(to)
    found = _odds(same.take(v, axis=0).ravel(), other.take(v, axis=0).ravel(), own_same, own_other, same_before, other_before)
    odds[to], known[to] = _words(found[0]), _words(found[1])


def _slices(first, length, most) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups, some of about ``most`` positions at a time."""
    for i, j in runs(np.append(0, np.cumsum(length)), most):
        yield first[i:j], length[i:j]


def _side_by_side(first, length) -> tuple[np.ndarray, np.ndarray]:
    """Positions of groups, one group after the other, and the rank of each in its group."""
    rank = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return rank + np.repeat(first, length), rank


def _visits(c, first, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, and for each one nine visits of its context's nodes, from the root to the byte: those before, and all of the group. A zero ends them.

    Groups are read side by side, one position of each at a time.
    """
    falling = np.argsort(-length, kind="stable")
    first, length = first[falling], length[falling]
    n = int(length.sum())
    steps = int(length[0]) if n else 0
    live = np.searchsorted(-length, -np.arange(steps), "left")
    stops = np.cumsum(live)
    group = np.arange(n) - np.repeat(stops - live, live)
    at = first.take(group) + np.repeat(np.arange(steps), live)
    # the bytes of each group, in order, and the nodes that lead to them
    leaves, leaf = _distinct((group.astype(U64) << U64(8)) | c.take(at))
    nodes_to = np.empty((len(leaves), 9), np.int64)
    for d in range(9):
        first = _starts(leaves >> U64(8 - d))
        nodes_to[:, d] = np.repeat(np.arange(d * len(leaves), d * len(leaves) + len(first)), np.diff(np.append(first, len(leaves))))
    seen = np.zeros(9 * len(leaves), F32)
    way = nodes_to.take(leaf, axis=0).ravel()
    before, whole = np.zeros(9 * n + 1, F32), np.zeros(9 * n + 1, F32)
    start = 0
    for stop in (9 * stops).tolist():
        here = way[start:stop]
        had = seen.take(here)
        before[start:stop] = had
        had += F32(1)
        seen[here] = had
        start = stop
    seen.take(nodes_to).take(leaf, axis=0, out=whole[:-1].reshape(-1, 9), mode="clip")
    return at, before, whole


def _long_visits(c, first, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for long groups, level by level, in sorted order."""
    at, rank = _side_by_side(first, length)
    n = len(at)
    before, whole = np.zeros(9 * n + 1, F32), np.zeros(9 * n + 1, F32)
    by_level = before[:-1].reshape(-1, 9), whole[:-1].reshape(-1, 9)
    by_level[0][:, 0], by_level[1][:, 0] = rank, np.repeat(length, length)
    pos_bits = U64(n.bit_length())
    number = np.arange(n)
    group = np.repeat(np.arange(len(first), dtype=U64), length) << U64(8)
    path = c.take(at)
    for d in range(1, 9):
        key = ((group | (path >> np.uint8(8 - d))) << pos_bits) | number.view(U64)
        key.sort()
        to = (key & ((U64(1) << pos_bits) - U64(1))).view(np.int64)
        key >>= pos_bits
        new = _starts(key)
        many = np.diff(np.append(new, n))
        by_level[0][to, d] = number - np.repeat(new, many)
        by_level[1][to, d] = np.repeat(many, many)
    return at, before, whole


_CENTRES = (1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) * MAP_STEP))).astype(F32)


def score_rows(b: np.ndarray, offsets: np.ndarray, tables: Tables, rest: list[Rest] | None = None) -> np.ndarray:
    """Total bits of each row. ``rest``: counts of the rows' contexts that have no place in the tables."""
    n = np.diff(offsets)
    bits = np.zeros(len(n))
    if not len(b):
        return bits
    x = evidence(b, offsets, tables, rest)
    parts = -(-n // SEGMENT)
    row = np.repeat(np.arange(len(n)), parts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = offsets[:-1][row] + inner * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][row] - first)
    falling = np.argsort(-size, kind="stable")
    taken = _code(b, first[falling], size[falling], x)
    np.add.at(bits, row[falling], taken)
    return bits


def _code(b, first, size, x) -> np.ndarray:
    """Bits of segments of falling size, one bit of each at a time."""
    count, k = len(first), x.shape[1] // 8 - 1
    weights = np.full((8, k, count), START / SCALE, F32)
    gain = np.ones(count * (k + 1), F32)
    cells = np.repeat(_CENTRES[None], 8 * count, axis=0).reshape(8, -1)
    cell_base = np.arange(count) * CELLS + CELLS // 2
    gain_base = np.arange(count) * (k + 1)
    spent = np.zeros(count)
    one, rate = F32(1), F32(RATE / SCALE)
    falling = -size
    for t in range(int(size[0])):
        live = int(np.searchsorted(falling, -t, "left"))
        place = first[:live] + t
        sign = b.take(place)
        xs = np.ascontiguousarray(x.take(place, axis=0).T).reshape(k + 1, 8, live)
        ls = xs[k].astype(np.int64)
        xs = xs[:k].astype(F32)
        ys = NODE_BITS.take(sign, axis=1)
        got = np.ones(live, F32)
        for d in range(8):
            y, xd, w = ys[d], xs[:, d], weights[d, :, :live]
            s = w[0] * xd[0]
            for i in range(1, k):
                s += w[i] * xd[i]
            gate = gain_base[:live] + ls[d]
            g = gain.take(gate)
            z = s * g
            np.maximum(z, F32(-MOST), out=z)
            np.minimum(z, F32(MOST), out=z)
            cell = np.rint(z * F32(1 / MAP_STEP)).astype(np.int64)
            cell += cell_base[:live]
            np.negative(z, out=z)
            p = np.exp(z, out=z)
            p += one
            np.reciprocal(p, out=p)
            table = cells[d]
            m = table.take(cell)
            q = m - p
            q *= F32(MAP_SHARE)
            q += p
            q += y
            q -= one
            np.abs(q, out=q)
            got *= q
            e = y - p
            e *= rate
            m += (y - m) * F32(MAP_RATE)
            table[cell] = m
            gain[gate] = g + e * s
            e *= g
            for i in range(k):
                w[i] += e * xd[i]
        spent[:live] -= np.log2(np.maximum(got, F32(1e-30)))
    return spent


def _scored(doc_id, text, tables: Tables, rest: list[Rest] | None = None) -> list[pa.Array]:
    whole, offsets = utf8(text)
    bits = np.zeros(len(text))
    for i, j in runs(offsets, SCORE_BLOCK):
        bits[i:j] = score_rows(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables, rest)
    n = np.diff(offsets)
    null = text.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = bits / n
    return [doc_id, pa.array(n, mask=null), pa.array(bits, mask=null), pa.array(rate, mask=null | (n == 0))]


COLUMNS = ["doc_id", "n_bytes", "total_bits", "bits_per_byte"]
SCHEMA = "doc_id long, n_bytes long, total_bits double, bits_per_byte double"


def score(docs: DataFrame, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """``score_all`` by the tables alone: contexts of the corpus that have no place there count for nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_scored(batch.column("doc_id"), batch.column("text"), shared.value), COLUMNS)

    return map_arrow(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), run, SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their block, of about ``SCORE_BLOCK`` bytes."""
    for batch in batches:
        for i, j in runs(utf8(batch.column("text"))[1], SCORE_BLOCK):
            block = pa.array(np.full(j - i, secrets.randbits(63), np.int64))
            some = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([block, some.column("doc_id"), some.column("text")], ["block", "doc_id", "text"])


def _asked(shared, part_bits: int):
    """``(part, block, k, h)``: the contexts of each block that have no place in the tables, in words of 4 bytes, apart by their first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        bounds = np.arange(1 << part_bits, dtype=np.int64) << (HASH_BITS - part_bits)
        for batch in batches:
            block = batch.column("block").to_numpy()
            first = _starts(block)
            whole, offsets = utf8(batch.column("text"))
            for i, j in zip(first.tolist(), np.append(first[1:], len(block)).tolist()):
                b, off = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for k, h in enumerate(contexts(b, off, tables.orders)):
                    h = h[tables.owner[k].take(h & tables.mask) != h]
                    h.sort()
                    h = h[_starts(h)]
                    at = np.append(np.searchsorted(h, bounds), len(h))
                    part = np.flatnonzero(at[1:] > at[:-1])
                    found = [h[at[q] : at[q + 1]].tobytes() for q in part.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), block[i])), pa.array(np.full(len(part), k, np.int32)), pa.array(found, pa.binary())], ["part", "block", "k", "h"])

    return run


ANSWER = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("h", pa.binary()), ("more", pa.binary()), ("byte", pa.binary()), ("n", pa.binary())])


def _answered(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """Counts of the contexts that blocks asked for: the contexts, how many bytes but one follow each, these bytes and how often. A context that the corpus has once tells nothing to the text it is from, and is left out."""
    ks, out = counts["k"].to_numpy(), []
    known = {}
    for k in np.unique(ks).tolist():
        pairs = (counts["h"].to_numpy()[ks == k] << 8) | counts["byte"].to_numpy()[ks == k]
        order = np.argsort(pairs)
        pairs, n = pairs[order], counts["n"].to_numpy()[ks == k][order]
        first = _starts(pairs >> 8)
        more = np.add.reduceat(n, first) > 1
        known[k] = pairs, n, (pairs[first] >> 8)[more], first[more], np.diff(np.append(first, len(pairs)))[more]
    for block, k, h in zip(asked["block"].to_pylist(), asked["k"].to_pylist(), asked["h"].to_pylist()):
        pairs, n, have, first, length = known.get(k, (None,) * 5)
        if have is None or not len(have):
            continue
        h = np.frombuffer(h, np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(have, h), len(have) - 1)
        at = at[have[at] == h]
        if len(at):
            h, more = have[at].astype(np.uint32), (length[at] - 1).astype(np.uint8)
            at = _side_by_side(first[at], length[at])[0]
            some = n[at]
            out.append({"block": block, "k": k, "h": h.tobytes(), "more": more.tobytes(), "byte": pairs[at].astype(np.uint8).tobytes(), "n": some.astype(np.min_scalar_type(int(some.max()))).tobytes()})
    return pa.Table.from_pylist(out, ANSWER)


def _rest(answers: pa.Table, orders: int) -> list[Rest]:
    pairs, counts = [[np.zeros(0, U64)] for _ in range(orders)], [[np.zeros(0, np.uint8)] for _ in range(orders)]
    # in the order of their contexts: parts hold ranges of them
    for k, _, h, more, byte, n in sorted((k, int.from_bytes(h[:4], "little"), h, more, byte, n) for k, h, more, byte, n in zip(*(answers[c].to_pylist() for c in ("k", "h", "more", "byte", "n")))):
        found = np.repeat(np.frombuffer(h, np.uint32).astype(U64) << U64(8), np.frombuffer(more, np.uint8).astype(np.int64) + 1)
        found |= np.frombuffer(byte, np.uint8)
        pairs[k].append(found)
        counts[k].append(np.frombuffer(n, f"u{len(n) // len(byte)}"))
    return [Rest(np.concatenate(p), np.concatenate(n)) for p, n in zip(pairs, counts)]


def score_all(docs: DataFrame, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """``(doc_id, n_bytes, total_bits, bits_per_byte)``, one row for each row of ``docs``.

    A null text has nulls; an empty one takes 0 bits and has null bits per byte. Repeated
    rows score alike, and each is part of the others' corpus, so that they are cheap. Texts of any length
    are read whole. Null and repeated ids are kept, extra columns are not read, an empty table gives an empty table.

    Rows are scored in blocks. Contexts that have no place in the tables are asked for by
    each block that has them, looked up in the corpus' counts part by part and brought to the block: bits are those of tables with a place for every context.
    """
    spark = docs.sparkSession
    blocks = materialise(map_arrow(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), _cut, "block long, doc_id long, text string"), "blocks")
    counts = _counted(blocks, orders)
    tables = _held(counts, orders)
    shared = spark.sparkContext.broadcast(tables)
    part_bits = min(max((counts.count() >> 16).bit_length(), 5), 24)
    asked = map_arrow(blocks.where("text IS NOT NULL").select("block", "text"), _asked(shared, part_bits), "part int, block long, k int, h binary")
    parted = counts.select(F.expr(f"CAST(shiftright(h, {HASH_BITS - part_bits}) AS INT)").alias("part"), "k", "h", "byte", "n")
    rest = asked.groupBy("part").cogroup(parted.groupBy("part")).applyInArrow(_answered, "block long, k int, h binary, more binary, byte binary, n binary")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        scored = _scored(rows["doc_id"].combine_chunks(), rows["text"].combine_chunks(), shared.value, _rest(answers, len(orders)))
        release()
        return pa.table(scored, COLUMNS)

    return blocks.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(run, SCHEMA)
