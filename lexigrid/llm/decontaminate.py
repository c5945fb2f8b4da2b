"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as letters and digits only: lower case,
as UTF-8 bytes without ASCII blanks and punctuation. An item is cut into
overlapping windows. A stretch of text within ``k`` edits of a window of ``w``
bytes shares ``w - q + 1 - k * q`` of its q-grams, on diagonals at most ``k``
apart. So shared q-grams are counted in overlapping diagonal bands, bands that reach the bound
are kept, and an alignment limited to the band decides. Hits are counted by row, window and
band, so neither other rows nor the cut into batches matter, and the filter loses nothing.

Memory has a bound that no batch and no benchmark moves: texts are compared ``BLOCK`` bytes at a time, hits are expanded into postings
``EXPAND`` at a time, a long row is looked at in overlapping stretches, and an index holds ``WINDOWS`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import U64, beside, blocks, id_of, packed, repeated, row_key, runs, unpacked, utf8
from lexigrid.shipping import map_arrow
from lexigrid.storage import materialise

Q = 8
WINDOW = 64
RATE = 0.1
BLOCK = 1 << 19
#: Hits taken apart at once.
EXPAND = 1 << 20
#: Different windows in an index: some 57 postings of 13 bytes each, 200 MB at most.
WINDOWS = 1 << 18
BITS = 20
#: Added to diagonals, which may be negative.
SHIFT = 1 << 10
_ODD = U64(0x9E6C63D0876A9A35)

_keep = np.zeros(256, bool)
_keep[128:] = True
_keep[[c for c in range(128) if chr(c).isalnum()]] = True


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What is compared of each row, end to end, and the offsets of the rows."""
    b, off = utf8(pc.utf8_lower(column))
    kept = _keep[b]
    # counted row by row: a running count would take eight bytes for each one of the text
    n = [np.count_nonzero(kept[i:j]) for i, j in pairwise(off.tolist())]
    return b[kept], np.cumsum([0, *n], dtype=np.int64)


def grams(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one word."""
    if len(b) < Q:
        return np.zeros(0, U64)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << 8)
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
    return four[:-4].astype(U64) | (four[4:].astype(U64) << U64(32))


#: ``(item_id, compared bytes of a window, whether the item has no other text)``
Window = tuple[int | None, bytes, bool]


def windows_of(item_id: int | None, text: str | None, window: int = WINDOW) -> Iterator[Window]:
    """An item's windows: half a window apart, the last one at the item's end. Items of fewer than ``Q`` bytes are one, and only a whole text equals them."""
    body = letters(pa.array([text], pa.string()))[0].tobytes()
    n = len(body)
    if n < Q:
        if n:
            yield item_id, body, True
        return
    for s in [0] if n <= window else sorted({*range(0, n - window + 1, window // 2), n - window}):
        yield item_id, body[s : s + window], False


class Index:
    """Different windows, the items they belong to, and where each q-gram stands in them."""

    def __init__(self, windows: list[Window], rate: float = RATE) -> None:
        owners: dict[bytes, set] = {}
        self.whole: dict[bytes, set] = {}
        for item_id, body, whole in windows:
            (self.whole if whole else owners).setdefault(body, set()).add(item_id)
        self.bodies = [np.frombuffer(b, np.uint8) for b in owners]
        self.items = [sorted(i, key=lambda x: (x is None, x)) for i in owners.values()]
        self.lengths = np.array([len(p) for p in self.bodies], np.int64)
        self.widest = int(self.lengths.max(initial=0))
        self.budget = np.minimum((rate * self.lengths + 1e-9).astype(np.int64), (self.lengths - Q) // Q)
        self.least = self.lengths - Q + 1 - self.budget * Q
        codes = [grams(p) for p in self.bodies]
        all_codes = np.concatenate(codes) if codes else np.zeros(0, U64)
        size = np.array([len(c) for c in codes], np.int64)
        owner = np.repeat(np.arange(len(codes), dtype=np.int32), size)
        place = (np.arange(len(all_codes)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int16)
        order = np.argsort(all_codes, kind="stable")
        all_codes = all_codes[order]
        self.codes, first = np.unique(all_codes, return_index=True)
        self.first = np.append(first, len(all_codes))
        self.owner, self.place = owner[order], place[order]
        self.half = 1
        while self.half <= self.budget.max(initial=0):
            self.half *= 2
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.codes * _ODD) >> U64(64 - BITS)] = True

    def candidates(self, b: np.ndarray, off: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, window, band)``: bands of diagonals ``[band * half, (band + 2) * half)`` of a row that reach the bound.

        Diagonals count from the start of the row; ``start`` says how much of the (only) row stands before ``b``.
        """
        none = (np.zeros(0, np.int64),) * 3
        g = grams(b)
        at = np.flatnonzero(self.seen[(g * _ODD) >> U64(64 - BITS)])
        if not len(at) or not len(self.codes):
            return none
        code = np.searchsorted(self.codes, g[at])
        code[code == len(self.codes)] = 0
        row = np.searchsorted(off, at, "right") - 1
        ok = (self.codes[code] == g[at]) & (at + Q <= off[row + 1])
        at, code, row = at[ok], code[ok], row[ok]
        if not len(at):
            return none
        local = at - off[row] + start
        width = (int(local.max()) + SHIFT) // self.half + 2
        count = self.first[code + 1] - self.first[code]
        total = np.cumsum(count)
        keys, counts = [], []
        i = 0
        while i < len(at):
            before = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + EXPAND, "right")))
            c = count[i:j]
            where = np.repeat(self.first[code[i:j]] - (total[i:j] - before) + c, c) + np.arange(int(total[j - 1]) - before)
            band = (np.repeat(local[i:j], c) - self.place[where] + SHIFT) // self.half
            key = (np.repeat(row[i:j], c) * len(self.bodies) + self.owner[where]) * width + band
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            counts.append(n)
            i = j
        key, n = keys[0], counts[0]
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        nxt = np.zeros_like(n)
        nxt[:-1] = np.where(key[1:] == key[:-1] + 1, n[1:], 0)
        # the band before this one in the sort is another window's where this is a window's first: width keeps them apart
        owner, band = key // width, key % width
        row, owner = owner // len(self.bodies), owner % len(self.bodies)
        up = n + nxt >= self.least[owner]
        return row[up], owner[up], band[up] - SHIFT // self.half

    def verify(self, b: np.ndarray, off: np.ndarray, row: np.ndarray, owner: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the candidates: the edits (a large number where over the budget) and where the stretch ends in its row."""
        edits = np.full(len(owner), 1 << 14, np.int64)
        ends = np.zeros(len(owner), np.int64)
        for w in np.unique(self.lengths[owner]):
            same = np.flatnonzero(self.lengths[owner] == w)
            for i in range(0, len(same), 4096):
                some = same[i : i + 4096]
                edits[some], ends[some] = self._align(int(w), b, off[row[some]], off[row[some] + 1], owner[some], band[some])
        return edits, ends

    def _align(self, w: int, b: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = int(self.budget[owner].max())
        low = band * self.half - k
        span = 2 * self.half + 2 * k + 1
        pattern = np.stack([self.bodies[o] for o in owner]).astype(np.int16)
        j = (first + low)[:, None] + np.arange(span + w)
        inside = (j >= first[:, None]) & (j < last[:, None])
        text = np.where(inside, b[np.clip(j, 0, max(0, len(b) - 1))].astype(np.int16), np.int16(-1))
        step = np.arange(span, dtype=np.int16)
        d = np.zeros((len(owner), span), np.int16)
        for i in range(w):
            new = d + (text[:, i : i + span] != pattern[:, i : i + 1])
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            d = np.minimum.accumulate(new - step, axis=1) + step
        found = d.argmin(axis=1)
        edits = d[np.arange(len(owner)), found].astype(np.int64)
        edits[edits > self.budget[owner]] = 1 << 14
        return edits, np.minimum(low + found + w, last - first)


def _hits(index: Index, column: pa.Array) -> Iterator[tuple[int, list, bytes | int, int, int]]:
    """``(row, items, window, edits, end)`` of what is verified. Memory follows ``BLOCK`` or the longest text, not the batch."""
    for i, j in blocks(column, BLOCK):
        for row, *hit in _block_hits(index, column.slice(i, j - i)):
            yield i + row, *hit


def _block_hits(index: Index, column: pa.Array) -> Iterator[tuple[int, list, bytes | int, int, int]]:
    b, off = letters(column)
    if index.whole:
        for r in np.flatnonzero((np.diff(off) < Q) & (np.diff(off) > 0)):
            body = b[off[r] : off[r + 1]].tobytes()
            if body in index.whole:
                yield int(r), sorted(index.whole[body], key=lambda x: (x is None, x)), body, 0, len(body)
    # a stretch holds whole any place of a window that starts in its first BLOCK bytes
    more = index.widest + 4 * index.half + Q
    for i, j in runs(off, BLOCK):
        part, o = b[off[i] : off[j]], off[i : j + 1] - off[i]
        stretches = [(0, len(part))] if j > i + 1 or len(part) <= BLOCK + more else [(s, min(len(part), s + BLOCK + more)) for s in range(0, len(part), BLOCK)]
        for s, e in stretches:
            here = o if len(stretches) == 1 else np.array([0, e - s])
            row, owner, band = index.candidates(part[s:e], here, s)
            if len(owner):
                edits, ends = index.verify(part, o, row, owner, band)
                for c in np.flatnonzero(edits < 1 << 14):
                    yield i + int(row[c]), index.items[owner[c]], int(owner[c]), int(edits[c]), int(ends[c])


def _parts(benchmark: DataFrame, window: int, most: int) -> Iterator[list[Window]]:
    """The windows in lists of at most ``most``: what is broadcast at once has a bound, however long an item is."""
    part: list[Window] = []
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").toLocalIterator():
        for w in windows_of(row[0], row[1], window):
            part.append(w)
            if len(part) >= most:
                yield part
                part = []
    yield part


def _scan(docs: DataFrame, windows: list[Window], rate: float) -> DataFrame:
    """``(doc_id, h, item_id, windows, edits, first_end)`` for the windows of one part; ``docs`` has ``doc_id, h, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(windows, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            best: dict[tuple[int, int | None], tuple[set, int, int]] = {}
            for row, items, name, edits, end in _hits(index, batch.column("text")):
                for item in items:
                    w, e, f = best.get((row, item), (set(), edits, end))
                    w.add(name)
                    best[row, item] = w, min(e, edits), min(f, end)
            out = [(ids[row], hashes[row], item, len(w), e, f) for (row, item), (w, e, f) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1]))]
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "h", "item_id", "windows", "edits", "first_end"])

    return map_arrow(docs, run, "doc_id long, h long, item_id long, windows int, edits int, first_end int")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rate: float = RATE, most: int = WINDOWS) -> DataFrame:
    """``(doc_id, item_id, windows, edits, first_end)``: which rows hold (a window of) which item.

    ``windows`` is how many different windows of the item occur, ``edits`` the least edits of one,
    ``first_end`` where the first place found ends, in compared bytes. One
    output row for each row of ``docs`` and item: repeated rows repeat, and items that repeat an ``item_id`` are
    one. A null ``doc_id`` or ``item_id`` stays null. An item shorter than a window is one window; one of fewer
    than 8 compared bytes is found only where it is the whole of a text. An edit budget is a tenth of the
    window, rounded down, less for items so short that the filter could lose some. Edits are counted in bytes.

    Null texts, empty ones and those without letters or digits match nothing, on either side; an empty table on either
    side gives no rows. Long texts are looked at whole, in overlapping stretches; their results are those of one look.
    Of extra columns none is read. A benchmark of more than ``most`` windows is scanned for part by part:
    each part reads the documents once.
    """
    parts = _parts(benchmark, window, most)
    windows, more = next(parts), next(parts, None)
    if more is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), "text")
        return _scan(rows, windows, rate).drop("h")
    rows = docs.select(row_key().alias("k"), "text").select(F.col("k.d").alias("doc_id"), "k.h", "text")
    found, part = _scan(rows, windows, rate).withColumn("part", F.lit(0)), 0
    while more is not None:
        part += 1
        found, more = found.unionByName(_scan(rows, more, rate).withColumn("part", F.lit(part))), next(parts, None)
    # an item may lie in several parts; rows that repeat come as often as they are there in each of them
    keys = ["doc_id", "h", "item_id"]
    each = found.groupBy(*keys, "part").agg(F.first("windows").alias("windows"), F.first("edits").alias("edits"), F.first("first_end").alias("first_end"), F.count(F.lit(1)).alias("m"))
    whole = each.groupBy(*keys).agg(F.sum("windows").cast("int").alias("windows"), F.min("edits").alias("edits"), F.min("first_end").alias("first_end"), F.max("m").alias("m"))
    return repeated(whole, "m").select(id_of(F.col("doc_id")).alias("doc_id"), "item_id", "windows", "edits", "first_end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rate: float = RATE, most: int = WINDOWS) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; all columns stay.

    What counts as held is what ``contamination`` says. Null and empty texts stay, so do all rows beside an empty benchmark;
    of repeated rows all stay or none. Extra columns are carried, whatever their names.
    """
    parts = _parts(benchmark, window, most)
    windows, more = next(parts), next(parts, None)
    rows = packed(docs)
    if more is None:
        shared = docs.sparkSession.sparkContext.broadcast(Index(windows, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column("r").field("text")
                bad = {h[0] for h in _hits(shared.value, text)}
                keep = np.ones(batch.num_rows, bool)
                keep[list(bad)] = False
                for i, j in blocks(text, BLOCK):
                    yield batch.slice(i, j - i).filter(pa.array(keep[i:j]))

        return unpacked(map_arrow(rows, run, rows.schema))
    # one index in a worker at a time: the parts' findings are united by document
    texts = docs.select(row_key().alias("k"), "text").select(F.col("k.d").alias("doc_id"), "k.h", "text")
    found = _scan(texts, windows, rate)
    while more is not None:
        found, more = found.unionByName(_scan(texts, more, rate)), next(parts, None)
    gone = beside(materialise(found.select("doc_id", "h").distinct(), "contaminated"))
    rows = rows.withColumn("k", row_key(F.col("r.doc_id"), F.col("r.text")))
    return unpacked(rows.join(gone, (F.col("k.d") == gone.doc_id) & (F.col("k.h") == gone.h), "left_anti"))
