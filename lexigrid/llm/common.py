"""What the text operators share.

Every operator works on rows as they come. A row is told apart by its
``doc_id`` and a 64-bit hash of its text (``row_key``), so null and repeated
ids are fine; rows alike in both are one document to an operator that orders
documents. Order between documents: ``doc_id`` ascending, null last, then the
hash. Extra columns are never looked at; operators that return whole rows carry
them inside one struct, so that no name can clash with a working column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
STEP = 1 << 16
GOLDEN = U64(0x9E3779B97F4A7C15)
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """``struct(d, h)``: sorts by doc_id with null last; alike for repeated rows only."""
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    t = F.col(text) if isinstance(text, str) else text
    return F.struct(F.coalesce(d.cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(t).alias("h"))


def id_of(key_d: Column) -> Column:
    """The doc_id of a key's ``d``; null where it stands for none."""
    return F.when(key_d != F.lit(NO_ID), key_d)


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row of ``df`` as often as its column ``times`` says (not at all below 1), without that column.

    In two steps, so that no row ever holds an array of more than ``STEP`` elements.
    """
    m = F.col(times)
    kept = [F.col(f"`{c}`") for c in df.columns if c != times]
    blocks = df.where(m > 0).select(*kept, m.alias("_m"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((m - 1) / STEP))).alias("_b"))
    return blocks.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP).cast("long"), F.col("_m") - F.col("_b") * STEP))).alias("_i")).select(*kept)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row whole in the struct ``r``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("r.*")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_rng = np.random.default_rng(20240117)
BYTE_WORD = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``n`` powers of the rolling-hash base (or of its inverse) modulo 2^64."""
    name = "i" if inverse else "b"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, _INVERSE if inverse else _BASE, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of a string column; null counts as empty."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return runs(np.concatenate(([0], np.cumsum(size, dtype=np.int64))), most)


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word (bytes above a blank, within a row)."""
    solid = b > 32
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    first = offsets[:-1]
    first = first[first < len(b)]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    last = offsets[1:]
    last = last[last > 0] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    total = np.zeros(len(b) + 1, dtype=U64)
    np.cumsum(BYTE_WORD[b] * powers(len(b), True), out=total[1:])
    h = (total[ends] - total[starts]) * powers(len(b) + 1)[starts]
    return starts, ends, mix(h + (ends - starts).astype(U64) * GOLDEN)


#: A side of a join is broadcast up to about so many bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def beside(table: DataFrame, width: int = 16, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with rows of about ``width`` bytes as the small side of a join: broadcast if its count allows, else left to Catalyst."""
    return F.broadcast(table) if table.count() * width <= most else table
