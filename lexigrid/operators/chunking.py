"""Documents to chunks. Everything happens within a row, so no chunker shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.text import token_count, windows, words
from lexigrid.storage import TASK_ROWS, materialise, tasks

SIZE, OVERLAP = 1200, 100
HEADING = r"^(#{1,6})[ \t]+(\S.*)$"


def chunk_words(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(chunk_id, doc_id, position, text, token_count)``: overlapping word windows; no words, no chunks."""
    split = docs.select(F.col(doc_id).cast("string").alias("doc_id"), words(F.col(text)).alias("w"))
    return _finish(split.select("doc_id", F.posexplode(windows(F.col("w"), size, overlap)).alias("position", "text")))


def _finish(chunks: DataFrame) -> DataFrame:
    extra = [c for c in chunks.columns if c not in ("doc_id", "position", "text")]
    return chunks.select(F.concat_ws(":", "doc_id", F.col("position").cast("string")).alias("chunk_id"), "doc_id", "position", "text", *extra, token_count(F.col("text")).alias("token_count"))


def sections(text: Column) -> Column:
    """Array of ``struct(level, title, body)``: what stands before the first heading has level 0, if it isn't blank."""
    parts = F.split(text, r"(?m)^(?=#{1,6}[ \t]+\S.*$)")
    first_line = r"^(#{1,6})[ \t]+([^\n]*)"

    def one(p: Column) -> Column:
        level = F.length(F.regexp_extract(p, first_line, 1))
        body = F.when(level > 0, F.regexp_extract(p, r"(?s)^[^\n]*\n?(.*)$", 1)).otherwise(p)
        return F.struct(level.alias("level"), F.trim(F.regexp_extract(p, first_line, 2)).alias("title"), F.trim(F.regexp_replace(body, r"\A\s+|\s+\z", "")).alias("body"))

    return F.filter(F.transform(parts, one), lambda s: (s["level"] > 0) | (s["body"] != ""))


def with_paths(section_list: Column, cumulative: bool = False) -> Column:
    """Array of ``struct(section, level, title, body, path)``: the open headings of each section.

    ``cumulative`` gives all headings so far instead, as some chunkers do.
    """
    empty = F.array().cast("array<struct<level:int,title:string>>")

    def stack(upto: Column) -> Column:
        head = F.filter(F.slice(section_list, 1, upto), lambda s: s["level"] > 0)
        if cumulative:
            return F.transform(head, lambda s: s["title"])
        open_ = F.aggregate(
            head, empty, lambda acc, s: F.concat(F.filter(acc, lambda a: a["level"] < s["level"]), F.array(F.struct(s["level"].cast("int").alias("level"), s["title"].alias("title"))))
        )
        return F.transform(open_, lambda s: s["title"])

    return F.transform(section_list, lambda s, i: F.struct(i.alias("section"), s["level"].alias("level"), s["title"].alias("title"), s["body"].alias("body"), stack(i + 1).alias("path")))


def split_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cumulative: bool = False) -> DataFrame:
    """``(doc_id, section, level, title, body, heading_path)`` of Markdown texts."""
    cut = docs.select(F.col(doc_id).cast("string").alias("doc_id"), sections(F.col(text)).alias("s"))
    paths = cut.select("doc_id", F.explode(with_paths(F.col("s"), cumulative)).alias("p"))
    return paths.select("doc_id", "p.section", "p.level", "p.title", "p.body", F.col("p.path").alias("heading_path"))


def chunk_sections(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text", cumulative: bool = False) -> DataFrame:
    """``(chunk_id, doc_id, position, text, heading_path, token_count)``: windows within sections, numbered through the document."""
    cut = docs.select(F.col(doc_id).cast("string").alias("doc_id"), sections(F.col(text)).alias("s"))
    each = cut.select("doc_id", with_paths(F.col("s"), cumulative).alias("p"))
    each = each.select("doc_id", F.transform("p", lambda p: F.struct(p["path"].alias("path"), words(p["body"]).alias("w"))).alias("p"))
    texts = F.flatten(F.transform("p", lambda p: F.transform(windows(p["w"], size, overlap), lambda t: F.struct(t.alias("text"), p["path"].alias("heading_path")))))
    out = each.select("doc_id", F.posexplode(texts).alias("position", "c")).select("doc_id", "position", "c.text", "c.heading_path")
    return _finish(out)


def group_rows(rows: DataFrame, text: Column, order: list[Column], by: Column, size: int = 50) -> DataFrame:
    """Spreadsheet-like blocks: rows of each ``by`` in order, ``size`` to a block, joined by line feeds."""
    cells = numbered(rows.select(by.cast("string").alias("doc_id"), text.alias("t"), *[c.alias(f"_o{n}") for n, c in enumerate(order)]), "doc_id", [f"_o{n}" for n in range(len(order))])
    block = cells.where("t <> ''").groupBy("doc_id", F.floor(F.col("i") / size).cast("int").alias("position")).agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("rows"))
    return _finish(block.select("doc_id", "position", F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("text")))


def numbered(rows: DataFrame, by: str, order: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` without ``order``, and ``i``: their place within ``by``, from 0.

    Few values of ``by`` may hold all rows, so no task holds one of them: rows are spread by ranges of both, numbered
    within a range, and moved on by what the ranges before have of the same ``by``.
    """
    n = tasks(rows.sparkSession, rows.count(), task_rows)
    keys = [F.col(c) for c in (by, *order)]
    ranges = rows.repartitionByRange(n, *keys) if n else rows.repartitionByRange(*keys)
    placed = materialise(ranges.sortWithinPartitions(*keys).drop(*order).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    of_range = placed.groupBy(F.shiftright("_m", 33).alias("_r"), by).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = of_range.select("_r", F.col(by).alias("_by"), (before - F.col("_first")).alias("_move"))
    # a row for each range, and for each value of ``by`` that begins in it
    out = placed.join(starts, (F.shiftright("_m", 33) == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.select(*[c for c in placed.columns if c != "_m"], (F.col("_m") + F.col("_move")).alias("i"))
