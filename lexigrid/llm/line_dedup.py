"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit of each other have a deletion variant in common: the
line itself or the line with one character taken out. All variants of a line go out
as 64-bit keys, keys that different lines share bring the lines together, and
the texts, compared without the characters in question, decide. Every occurrence of a line but the
earliest one of the line, or of a line within the bound of it, is dropped.

Variants are emitted for lines that can have a partner at all: one edit
leaves either the first or the second half of a line as it was, so lines whose
halves (cut for either length) nobody shares have none. This loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import GOLDEN, U64, beside, mix, packed, row_key, unpacked
from lexigrid.shipping import map_arrow
from lexigrid.storage import discard, materialise

#: The edit bound is one for lines of so many characters, and none below: an edit in a short line makes it another one ("Chapter 1", "Chapter 2").
MIN_CHARS = 24
#: Variants made at once.
VARIANTS = 1 << 17


def _lines(docs: DataFrame) -> DataFrame:
    """``(d, h, at, line)`` of each line that is not blank, trimmed of spaces, tabs and carriage returns."""
    # the key first: beside the generator it would hash the whole text once for each line
    rows = docs.select(row_key().alias("k"), F.split(F.col("text"), "\n").alias("lines")).select("k", F.posexplode("lines").alias("at", "line"))
    # trimming of given characters walks the whole line: it is for lines that have some at an end
    line = F.col("line")
    ends = [f(line, F.lit(c)) for f in (F.startswith, F.endswith) for c in " \t\r"]
    return rows.select("k.d", "k.h", "at", F.when(reduce(or_, ends), F.expr("trim(BOTH ' \t\r' FROM line)")).otherwise(line).alias("line")).where("line <> ''")


def _name(line: Column) -> Column:
    """128-bit name of a line: equal names are taken for equal lines."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _halves(line: Column, n: Column) -> Column:
    """Keys of the halves that an edit may leave alone, for this length and as the longer one of a pair."""
    keys = []
    for shorter in (n, n - 1):
        p = F.floor(shorter / 2).cast("int")
        q = (shorter - p).cast("int")
        keys.append(F.xxhash64(F.lit(2), shorter, line.substr(F.lit(1), p)))
        keys.append(F.xxhash64(F.lit(3), shorter, line.substr(n - q + 1, q)))
    return F.array(*keys)


def _keys(line: str, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the line and of each of its variants, and which character is out (-1: none), ``VARIANTS`` at a time.

    The hash of c0..cn-1 is the sum of ci * base^i; what follows a deletion moves one place down.
    """
    text = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    n = len(text)

    def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Characters from a place on, with base^i for each and the one after the last."""
        first = np.ones(1, U64)
        for s in range(0, n, VARIANTS):
            code = mix(text[s : s + VARIANTS].astype(U64) + GOLDEN)
            power = np.full(len(code) + 1, base, dtype=U64)
            power[:1] = first
            np.multiply.accumulate(power, out=power)
            first = power[-1:]
            yield s, code, power

    inverse = U64(pow(base, -1, 1 << 64))
    total, later = np.zeros(1, U64), np.zeros(1, U64)
    for _, code, power in parts():
        total += np.sum(code * power[:-1], dtype=U64)
    for s, code, power in parts():
        later += np.sum((code * power[:-1])[1 if s == 0 else 0 :] * inverse, dtype=U64)
    yield mix(total + np.full(1, n, U64) * GOLDEN), np.full(1, -1, np.int32)
    before = np.zeros(1, U64)
    after = later
    for s, code, power in parts():
        value = code * power[:-1]
        head = before + (np.cumsum(value) - value)
        moved = value * inverse
        if s == 0:
            moved[0] = 0
        rest = after - np.cumsum(moved)
        before, after = before + np.sum(value, dtype=U64), rest[-1:]
        yield mix(head + rest + np.full(1, n - 1, U64) * GOLDEN), np.arange(s, s + len(code), dtype=np.int32)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(vk, at, a, b)``: the key of each variant, and which character is out (-1: none)."""
    base = int(np.random.default_rng(600_613).integers(1 << 62, 1 << 63)) | 1
    pieces: list[tuple[np.ndarray, np.ndarray, int, int]] = []
    held = 0

    def out() -> pa.RecordBatch:
        reps = [len(v) for v, _, _, _ in pieces]
        cols = [np.concatenate([v for v, _, _, _ in pieces]).view(np.int64), np.concatenate([i for _, i, _, _ in pieces]), np.repeat([a for _, _, a, _ in pieces], reps), np.repeat([b for _, _, _, b in pieces], reps)]
        pieces.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["vk", "at", "a", "b"])

    for batch in batches:
        for line, a, b in zip(batch.column("line").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            for keys, out_at in _keys(line, base):
                pieces.append((keys, out_at, a, b))
                held += len(keys)
                if held > VARIANTS:
                    yield out()
                    held = 0
    if pieces:
        yield out()


def line_drops(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(d, h, at)``: the occurrences to drop."""
    lines = _lines(docs)
    named = lines.select(_name(F.col("line")).alias("l"), "d", "h", "at", F.length("line").alias("n"), _halves(F.col("line"), F.length("line")).alias("halves"))
    spots = named.select("l.a", "l.b", "d", "h", "at")
    long = named.where(F.col("n") >= min_chars)
    spot = F.struct("d", "h", "at")
    known = long.groupBy("l.a", "l.b").agg(F.min(spot).alias("first"), F.first("halves").alias("halves"))
    known = materialise(known, "lines")

    half = known.select("a", "b", F.explode(F.array_distinct("halves")).alias("hk"))
    met = half.groupBy("hk").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.min("b").alias("lo2"), F.max("b").alias("hi2")).where("lo <> hi OR lo2 <> hi2").select("hk")
    chosen = materialise(half.join(met, "hk", "left_semi").select("a", "b").distinct().join(known.select("a", "b", "first"), ["a", "b"]), "halves")

    # the earliest occurrence of each chosen line gives its text
    texts = lines.where(F.length("line") >= min_chars).join(beside(chosen.select("first.d", "first.h", "first.at", "a", "b"), 96), ["d", "h", "at"]).select("a", "b", "line").dropDuplicates(["a", "b"])
    texts = materialise(texts, "texts")
    # lines that share a variant are the variant with one character put in: their number has a bound, and so have the sets
    variants = map_arrow(texts, _variants, "vk long, at int, a long, b long")
    met = variants.groupBy("vk").agg(F.collect_set(F.struct("a", "b", "at")).alias("m")).where("size(m) > 1")
    met = materialise(met.select("vk", F.explode("m").alias("m")).select("vk", "m.a", "m.b", "m.at").join(chosen, ["a", "b"]).select("vk", "at", "a", "b", "first"), "met")
    # a substitution leaves the same variant at the same place: the earliest of them serves all others
    least = met.where("at >= 0").groupBy("vk", "at").agg(F.min(F.struct("first", "a", "b")).alias("e"))
    swaps = met.join(least, ["vk", "at"]).where("first > e.first").select("a", "b", F.col("e.a").alias("ea"), F.col("e.b").alias("eb"), "at", F.lit(0).alias("longer"))
    # an insertion: one line is the other's variant
    short = met.where("at < 0").select("vk", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("first").alias("sf"))
    inserts = met.where("at >= 0").join(short, "vk")
    later = inserts.select(F.when(F.col("first") > F.col("sf"), F.struct("a", "b", F.col("sa").alias("ea"), F.col("sb").alias("eb"), "at", F.lit(1).alias("longer"))).otherwise(F.struct(F.col("sa").alias("a"), F.col("sb").alias("b"), F.col("a").alias("ea"), F.col("b").alias("eb"), "at", F.lit(2).alias("longer"))).alias("p")).select("p.*")
    pairs = swaps.unionByName(later).where("a <> ea OR b <> eb").distinct()
    pairs = pairs.join(texts, ["a", "b"]).join(texts.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("line").alias("earlier")), ["ea", "eb"])
    # where the edit is, is known: the texts without that character are compared, in time that follows their length
    one, two = F.expr("concat(substring(line, 1, at), substring(line, at + 2))"), F.expr("concat(substring(earlier, 1, at), substring(earlier, at + 2))")
    same = F.when(F.col("longer") == 2, F.col("line")).otherwise(one) == F.when(F.col("longer") == 1, F.col("earlier")).otherwise(two)
    near = materialise(pairs.where(same).select("a", "b").distinct(), "near")
    discard(known, chosen, texts, met)

    # equal lines: all occurrences but the earliest; lines near an earlier one: all occurrences
    ranked = spots.groupBy("a", "b").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("c"))
    ranked = ranked.join(near.withColumn("near", F.lit(True)), ["a", "b"], "left").where("c > 1 OR near")
    gone = spots.join(ranked, ["a", "b"]).where(F.col("near").isNotNull() | (spot != F.col("first")))
    return gone.select("d", "h", "at")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all columns stay, ``n_chars`` follows the text.

    Lines end at a line feed and are compared without spaces, tabs and carriage returns
    around them. A line is dropped where an equal line occurs earlier, or, from ``min_chars``
    characters on, where any earlier line (kept or not) of at least that length is within one edit
    (insertion, deletion or substitution of a character). Earlier means a
    lesser document key (doc_id ascending, null last, then the hash of the text), then a lesser line number.
    Blank lines stay. A document goes when it had a line that is not blank
    and all of those are dropped; null, empty and blank texts stay as they are. Rows
    that repeat doc_id and text are one document and fare alike. Time follows the number of lines and
    of characters, however many one document has. Extra columns are carried, whatever their names; an
    empty table stays empty. Lines are told apart by two 64-bit hashes.
    """
    gone = line_drops(docs, min_chars).groupBy("d", "h").agg(F.collect_set("at").alias("gone"))
    rows = packed(docs).withColumn("k", row_key(F.col("r.doc_id"), F.col("r.text")))
    rows = rows.join(gone, (F.col("k.d") == gone.d) & (F.col("k.h") == gone.h), "left").select("r", "gone")
    # by hashing: looking each line up in the list of dropped ones would take the square of a document's lines
    # the generator keeps Catalyst from putting the split into the lambda, when it pushes the filter down
    rows = rows.select("r", "gone", F.explode(F.array(F.when(F.col("gone").isNotNull(), F.split(F.col("r.text"), "\n")))).alias("lines"))
    rows = rows.withColumn("stay", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")))
    rows = rows.withColumn("kept", F.transform("stay", lambda i: F.get(F.col("lines"), i)))
    rows = rows.where(F.col("gone").isNull() | F.exists("kept", lambda x: F.trim(F.translate(x, "\t\r", "  ")) != ""))
    text = F.when(F.col("kept").isNull(), F.col("r.text")).otherwise(F.array_join("kept", "\n"))
    cols = []
    for c in docs.columns:
        old = F.col(f"r.`{c}`")
        if c == "text":
            old = text
        elif c == "n_chars":
            old = F.when(F.col("kept").isNull(), old).otherwise(F.length(text)).cast(docs.schema[c].dataType)
        cols.append(old.alias(c))
    return rows.select(*cols)


SQL = f"""
WITH occ AS (
  SELECT doc_id, i - 1 AS ln, trim(ls[i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) t,
       unnest(range(1, len(ls) + 1)) u(i)),
spot AS (SELECT doc_id, ln, line, length(line) AS n FROM occ WHERE line <> ''),
known AS (SELECT line, n, min(row(doc_id, ln)) AS first FROM spot GROUP BY line, n),
half AS (
  SELECT line, n, first, s, 0 AS side, left(line, s // 2) AS part FROM known, unnest([n, n - 1]) u(s) WHERE n >= {MIN_CHARS}
  UNION ALL
  SELECT line, n, first, s, 1, right(line, s - s // 2) FROM known, unnest([n, n - 1]) u(s) WHERE n >= {MIN_CHARS}),
near AS (
  SELECT DISTINCT x.line FROM half x JOIN half y ON x.s = y.s AND x.side = y.side AND x.part = y.part
  WHERE x.first > y.first AND abs(x.n - y.n) <= 1 AND levenshtein(x.line, y.line) <= 1),
gone AS (
  SELECT s.doc_id, list(s.ln) AS ats FROM spot s JOIN known k ON s.line = k.line
  WHERE row(s.doc_id, s.ln) <> k.first OR s.line IN (SELECT line FROM near) GROUP BY s.doc_id),
done AS (
  SELECT d.doc_id, d.lang, d.source, d.text, d.n_chars, g.ats, string_split(d.text, chr(10)) AS ls
  FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id),
kept AS (
  SELECT *, list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN list_contains(ats, i - 1) THEN NULL ELSE ls[i] END), lambda x: x IS NOT NULL) AS ks
  FROM done)
SELECT doc_id, CASE WHEN ats IS NULL THEN text ELSE array_to_string(ks, chr(10)) END AS text, lang, source,
       CASE WHEN ats IS NULL THEN n_chars ELSE length(array_to_string(ks, chr(10))) END AS n_chars
FROM kept
WHERE ats IS NULL OR len(list_filter(ks, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) > 0"""
