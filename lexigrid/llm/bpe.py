"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Every adjacent pair that the vocabulary
can merge puts its position into the bucket of its merge rank; a hierarchical
bitmap marks the buckets that are not empty, so find-first-set gives the least
rank. A popped position whose pair has another rank by now is stale and is
skipped. Each merge adds two entries at most, so a pre-token of n bytes takes some n queue
operations, however long it is. Equal ranks merge from left to right: within a
bucket positions are taken in order, found in the list of the pairs' ranks in pre-tokens of ``WORD`` bytes at most, from one bitmap in other short ones, and in those over ``DENSE`` bytes from the
same hierarchy of bitmaps over positions, of 256 to a leaf, made for the bucket when it is first used.

Texts are cut into pre-tokens by the public pattern of the vocabulary; the
pieces found so far are kept within a worker.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexigrid.llm.common import blocks
from lexigrid.shipping import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 256
PAIR = 20
#: Up to so many bytes the positions of a bucket are looked for in the list of the pairs' ranks.
WORD = 48
DENSE = 256
_BIT = [1 << k for k in range(1 << 12)]
CACHED = 400_000
#: Bytes of text encoded at once.
BLOCK = 1 << 20


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Places:
    """A set of positions that gives its least one: bits in leaves of 256, under levels that mark the leaves in use."""

    __slots__ = ("levels",)

    def __init__(self, depth: int) -> None:
        self.levels: list[dict[int, int]] = [{} for _ in range(depth)]

    def add(self, at: int) -> None:
        for level in self.levels:
            bit, at = at & 255, at >> 8
            held = level.get(at, 0)
            level[at] = held | _BIT[bit]
            if held:
                return

    def pop(self) -> tuple[int, bool]:
        """The least position, and whether it was the last one."""
        at = 0
        for level in reversed(self.levels):
            held = level[at]
            at = (at << 8) + (held & -held).bit_length() - 1
        place = at
        for level in self.levels:
            bit, at = at & 255, at >> 8
            held = level[at] ^ _BIT[bit]
            if held:
                level[at] = held
                return place, False
            del level[at]
        return place, True


class Merger:
    """A vocabulary's merges, and the rank queue that orders them.

    The queue is a bitmap of three levels: ``top`` marks the leaves in use, a leaf the buckets (ranks) in
    use, a bucket the positions in it. In pieces of up to ``WORD`` bytes there are no buckets: the
    list of the pairs' ranks tells the positions. In pieces of more than ``DENSE`` bytes a bucket is a ``_Places``, so that
    its size follows what is in it. The queue is empty between pieces and is used again.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = [ranks[bytes([i])] for i in range(256)]
        get = ranks.get
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    pairs[a << PAIR | b] = rank
        #: Rank of what two adjacent parts become.
        self.merged = pairs.get
        #: The same for two bytes; -1: none.
        self.two = [[get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        n = max(ranks.values()) + 1
        self.bits = [0] * n
        self.leaves = [0] * (n // LEAF + 1)

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single = self.single
        part = [single[c] for c in piece]
        if len(part) <= min(WORD, DENSE):
            two = self.two
            self._word(part, [two[a][b] for a, b in zip(piece, piece[1:])])
            return part
        if len(part) > DENSE:
            self._long(part)
        elif part:
            self._short(part)
        return [p for p in part if p >= 0]

    def _word(self, part: list[int], rank: list[int]) -> None:
        """Merge in place, without the parts that went into others. ``rank``: of each pair, by now (-1: none), so that a stale bucket is one whose rank no pair has."""
        merged, leaves, bit = self.merged, self.leaves, _BIT
        top = 0
        for r in rank:
            if r >= 0:
                leaves[r >> 8] |= bit[r & 255]
                top |= bit[r >> 8]
        while top:
            mark = top & -top
            hi = mark.bit_length() - 1
            leaf = leaves[hi]
            low = leaf & -leaf
            leaves[hi] = leaf = leaf ^ low
            if not leaf:
                top ^= mark
            least = (hi << 8) + low.bit_length() - 1
            if least not in rank:
                continue
            i = rank.index(least)
            part[i] = least
            del part[i + 1], rank[i]
            if i < len(rank):
                r = rank[i] = merged(least << PAIR | part[i + 1], -1)
                if r >= 0:
                    leaves[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
            if i:
                r = rank[i - 1] = merged(part[i - 1] << PAIR | least, -1)
                if r >= 0:
                    leaves[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
            if least in rank:
                leaves[hi] |= low
                top |= mark

    def _short(self, part: list[int]) -> None:
        """Merge in place: a part that went into the one before it becomes -1."""
        merged, bits, leaves, bit = self.merged, self.bits, self.leaves, _BIT
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        top = i = 0
        a = part[0]
        for b in part[1:]:
            r = merged(a << PAIR | b)
            if r is not None:
                held = bits[r]
                bits[r] = held | bit[i]
                if not held:
                    leaves[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
            i += 1
            a = b
        while top:
            hi = (top & -top).bit_length() - 1
            leaf = leaves[hi]
            low = leaf & -leaf
            rank = (hi << 8) + low.bit_length() - 1
            held = bits[rank]
            p = held & -held
            i = p.bit_length() - 1
            bits[rank] = held = held ^ p
            if not held:
                leaves[hi] = leaf = leaf ^ low
                if not leaf:
                    top ^= bit[hi]
            a = part[i]
            mid = after[i]
            # stale: the part is gone, or its pair has another rank by now
            if a < 0 or mid >= n or merged(a << PAIR | part[mid]) != rank:
                continue
            part[i], part[mid] = rank, -1
            stop = after[i] = after[mid]
            if stop < n:
                before[stop] = i
                r = merged(rank << PAIR | part[stop])
                if r is not None:
                    held = bits[r]
                    bits[r] = held | bit[i]
                    if not held:
                        leaves[r >> 8] |= bit[r & 255]
                        top |= bit[r >> 8]
            left = before[i]
            if left >= 0:
                r = merged(part[left] << PAIR | rank)
                if r is not None:
                    held = bits[r]
                    bits[r] = held | bit[left]
                    if not held:
                        leaves[r >> 8] |= bit[r & 255]
                        top |= bit[r >> 8]

    def _long(self, part: list[int]) -> None:
        merged, leaves = self.merged, self.leaves
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, _Places] = {}
        depth = 1
        while 256**depth < n:
            depth += 1
        top = 0

        def push(rank: int, position: int) -> None:
            nonlocal top
            bucket = buckets.get(rank)
            if bucket is not None:
                bucket.add(position)
            else:
                buckets[rank] = bucket = _Places(depth)
                bucket.add(position)
                leaves[rank >> 8] |= _BIT[rank & 255]
                top |= 1 << (rank >> 8)

        for i in range(n - 1):
            r = merged(part[i] << PAIR | part[i + 1])
            if r is not None:
                push(r, i)
        while top:
            hi = (top & -top).bit_length() - 1
            leaf = leaves[hi]
            low = leaf & -leaf
            rank = (hi << 8) + low.bit_length() - 1
            i, last = buckets[rank].pop()
            if last:
                del buckets[rank]
                leaves[hi] = leaf ^ low
                if not leaves[hi]:
                    top ^= 1 << hi
            a, mid = part[i], after[i]
            if a < 0 or mid >= n or merged(a << PAIR | part[mid]) != rank:
                continue
            part[i], part[mid] = rank, -1
            stop = after[i] = after[mid]
            if stop < n:
                before[stop] = i
                r = merged(rank << PAIR | part[stop])
                if r is not None:
                    push(r, i)
            left = before[i]
            if left >= 0:
                r = merged(part[left] << PAIR | rank)
                if r is not None:
                    push(r, left)


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token, by a merger of its own."""
    return Merger(ranks).encode(piece)


class _Pieces(dict):
    """Pre-token to the bytes of its ids (32-bit, little-endian); filled as they are met.

    Two generations of ``CACHED`` / 2: when the young one is full it becomes the old one, and what is met again comes back.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.encode = Merger(ranks).encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def encode_text(text: str, pieces: _Pieces) -> bytes:
    return b"".join(map(pieces.__getitem__, _find(text)))


_find = regex.compile(PATTERN).findall


def decode_ids(ids: list[int], tokens: list[bytes]) -> bytes:
    """The bytes of the ids; an id that is null, negative, too large or nobody's is a ``ValueError``."""
    for i in ids:
        if i is None or not 0 <= i < len(tokens) or not tokens[i]:
            raise ValueError(f"no token has the id {i}")
    return b"".join(map(tokens.__getitem__, ids))


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


def _lists(bodies: list[bytes | None]) -> pa.ListArray:
    off = np.zeros(len(bodies) + 1, np.int32)
    np.cumsum([len(b) // 4 if b is not None else 0 for b in bodies], out=off[1:])
    values = pa.array(np.frombuffer(b"".join(b for b in bodies if b is not None), "<i4"))
    mask = pa.array([b is None for b in bodies])
    return pa.ListArray.from_arrays(pa.array(off), values, mask=mask)


_worker: dict[str, tuple] = {}


def _encoded(batch: pa.RecordBatch, pieces: _Pieces, tokens: list[bytes], verify: bool) -> pa.RecordBatch:
    bodies, exact = [], []
    for text in batch.column("text").to_pylist():
        if text is None:
            bodies.append(None)
            exact.append(None)
            continue
        body = encode_text(text, pieces)
        bodies.append(body)
        if verify:
            exact.append(b"".join(map(tokens.__getitem__, memoryview(body).cast("i"))) == text.encode())
    out = [batch.column("doc_id"), _lists(bodies), pa.array([None if b is None else len(b) // 4 for b in bodies], pa.int32())]
    names = ["doc_id", "token_ids", "n_tokens"]
    if verify:
        out.append(pa.array(exact, pa.bool_()))
        names.append("round_trip")
    return pa.RecordBatch.from_arrays(out, names)


def _encoder(shared, name: str, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _worker:
            ranks = shared.value
            _worker.clear()
            _worker[name] = _Pieces(ranks), token_bytes(ranks)
        pieces, tokens = _worker[name]
        for batch in batches:
            # strings, ids and what is joined of them are those of a block at a time
            for i, j in blocks(batch.column("text"), BLOCK):
                yield _encoded(batch.slice(i, j - i), pieces, tokens, verify)

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, verify: bool = True) -> DataFrame:
    """``(doc_id, token_ids, n_tokens, round_trip)``, one row for each row of ``docs``.

    With ``verify`` every row's ids are decoded again and compared with the
    bytes of its text. A null text has null ids; an empty one has none, and
    ``n_tokens`` 0. Row order, null ids and repeats do not matter; an empty table
    gives an empty table. Texts and pre-tokens of any length are encoded whole; of extra columns none is read. The vocabulary is read on the driver and broadcast;
    its size does not depend on the data.
    """
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    schema = "doc_id long, token_ids array<int>, n_tokens int" + ", round_trip boolean" * verify
    return map_arrow(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), _encoder(shared, name, verify), schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, token_ids)``; null ids give a null text, an empty list an empty one.

    An id that is null, negative or not in the vocabulary is an error. Bytes that are no UTF-8 become
    replacement signs. Repeated rows repeat, extra columns are not read, an empty table gives an empty one.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(shared.value)
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, tokens).decode("utf-8", "replace") for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.selectExpr("CAST(doc_id AS LONG) AS doc_id", "token_ids"), run, "doc_id long, text string")
