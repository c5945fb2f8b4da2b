"""Files to documents and chunks, through a registry of parsers by extension.

A parser is a DataFrame transform: ``(doc_id, text)`` or ``(doc_id, content)``
in, chunks out. Text formats stay in the JVM. Office formats are unpacked by
Arrow batches; formats whose libraries are missing give no chunks unless a
reader is registered for them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import html_to_markdown
from lexigrid.operators import chunking
from lexigrid.shipping import map_arrow

Transform = Callable[[DataFrame, int, int], DataFrame]


@dataclass(frozen=True)
class Parser:
    name: str
    extensions: tuple[str, ...]
    mime: str
    run: Transform
    binary: bool = False


_parsers: dict[str, Parser] = {}


def register(name: str, extensions: tuple[str, ...], mime: str, binary: bool = False) -> Callable[[Transform], Transform]:
    """Register a transform as the parser of some extensions; a later one takes an extension over."""

    def add(run: Transform) -> Transform:
        _parsers[name] = Parser(name, tuple(e.lower() for e in extensions), mime, run, binary)
        return run

    return add


def supported_extensions() -> list[str]:
    return sorted({e for p in _parsers.values() for e in p.extensions})


def get_parser(path: str) -> Parser:
    """By extension; text where nothing else claims it."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    found = _parsers["text"]
    for p in _parsers.values():
        if ext in p.extensions:
            found = p
    return found


def parser_of(path: Column) -> Column:
    """Name of the parser for a path column."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    owner = {e: p.name for p in _parsers.values() for e in p.extensions}
    out = F.lit("text")
    for name in dict.fromkeys(owner.values()):
        out = F.when(ext.isin([e for e, n in owner.items() if n == name]), F.lit(name)).otherwise(out)
    return out


def parse(name: str, docs: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    return _parsers[name].run(docs, size, overlap)


def scan_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, length, content)`` of the visible files directly in ``folder``; none where it doesn't exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "path string, name string, length long, content binary"
    if not fs.exists(p) or not any(x.isFile() for x in fs.listStatus(p)):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), "length", "content").where("NOT startswith(name, '.')")


def identify(files: DataFrame) -> DataFrame:
    """File rows with ``doc_id``, ``content_hash``, ``title``, ``mime_type`` and ``parser``."""
    parser = parser_of(F.col("name"))
    mime = F.lit("text/plain")
    for p in _parsers.values():
        mime = F.when(F.col("parser") == p.name, F.lit(p.mime)).otherwise(mime)
    out = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("parser", parser)
    return out.withColumn("doc_id", F.substring("content_hash", 1, 16)).withColumn("title", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")).withColumn("mime_type", mime)


def ingest(files: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """``(documents, chunks)`` of scanned files, each through the parser of its extension. Equal contents are one document."""
    found = identify(files).dropDuplicates(["doc_id"])
    parts = []
    for p in _parsers.values():
        own = found.where(F.col("parser") == p.name)
        own = own.select("doc_id", "content") if p.binary else own.select("doc_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        part = p.run(own, size, overlap)
        if "heading_path" not in part.columns:
            part = part.withColumn("heading_path", F.array().cast("array<string>"))
        parts.append(part.select("chunk_id", "doc_id", "position", "text", "heading_path", "token_count"))
    chunks = reduce(DataFrame.unionByName, parts)
    return found.select("doc_id", "title", F.col("path").alias("source_path"), "mime_type", "content_hash"), chunks


@register("text", ("txt", "csv", "log", "tsv"), "text/plain")
def _text(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunking.chunk_words(docs, size, overlap)


@register("markdown", ("md", "mdx", "markdown"), "text/markdown")
def _markdown(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunking.chunk_sections(docs, size, overlap)


@register("html", ("html", "htm"), "text/html")
def _html(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunking.chunk_sections(docs.select("doc_id", html_to_markdown(F.col("text")).alias("text")), size, overlap)


_readers: dict[str, Callable[[bytes], str]] = {}


def set_reader(name: str, read: Callable[[bytes], str]) -> None:
    """What turns the bytes of a ``pdf`` or ``image`` into Markdown or text, e.g. by a library or OCR model at hand."""
    _readers[name] = read


def _read_all(docs: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if c is None else read(c) for c in b.column("content").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(docs.select("doc_id", "content"), run, "doc_id string, text string")


def _external(name: str, docs: DataFrame) -> DataFrame:
    read = _readers.get(name)
    if read is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("text")).where("false")
    return _read_all(docs, read)


@register("pdf", ("pdf",), "application/pdf", True)
def _pdf(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunking.chunk_sections(_external("pdf", docs), size, overlap)


@register("image", ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp"), "image/*", True)
def _image(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunking.chunk_words(_external("image", docs), size, overlap)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(node: ElementTree.Element | None, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "") if node is not None else ""


def docx_markdown(content: bytes) -> str:
    """Paragraphs of a word-processor file; heading styles become ``#`` lines. What can't be read is empty."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    out = []
    for p in (n for n in root.iter() if _local(n.tag) == "p"):
        text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip()
        style = _attribute(next((n for n in p.iter() if _local(n.tag) == "pStyle"), None), "val")
        level = re.fullmatch(r"[Hh]eading\s*([1-6])", style)
        if text:
            out.append(f"{'#' * int(level[1])} {text}" if level else text)
    return "\n".join(out)


@register("docx", ("docx",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", True)
def _docx(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunking.chunk_sections(_read_all(docs, docx_markdown), size, overlap)


def pptx_slides(content: bytes) -> list[tuple[int, str, str]]:
    """``(position, heading, text)`` of each slide with text: its first text box names it."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
            for k, n in enumerate(sorted(names, key=lambda n: int(re.sub(r"\D", "", n)))):
                root = ElementTree.fromstring(z.read(n))
                boxes = ["\n".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in s.iter() if _local(p.tag) == "p").strip() for s in root.iter() if _local(s.tag) == "sp"]
                boxes = [b for b in boxes if b]
                if boxes:
                    out.append((k, f"Slide {k + 1}: {boxes[0][:80]}", "\n".join(boxes[1:] or boxes)))
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []
    return out


def xlsx_rows(content: bytes) -> list[tuple[str, str]]:
    """``(sheet, cells joined by " | ")`` of each row that isn't blank."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"]
            titles = [_attribute(n, "name") for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]
            parts = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
            for k, n in enumerate(parts):
                for row in (x for x in ElementTree.fromstring(z.read(n)).iter() if _local(x.tag) == "row"):
                    cells = []
                    for c in (x for x in row if _local(x.tag) == "c"):
                        value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                        if c.get("t") == "s" and value:
                            value = shared[int(value)]
                        elif c.get("t") == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                        if value.strip():
                            cells.append(value.strip())
                    if cells:
                        out.append((titles[k] if k < len(titles) else f"Sheet{k + 1}", " | ".join(cells)))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError):
        return []
    return out


def sheet_blocks(content: bytes, rows_each: int = 50) -> list[tuple[int, str, str]]:
    out: list[tuple[int, str, str]] = []
    rows = xlsx_rows(content)
    for sheet in dict.fromkeys(s for s, _ in rows):
        own = [t for s, t in rows if s == sheet]
        for i in range(0, len(own), rows_each):
            out.append((len(out), sheet, "\n".join(own[i : i + rows_each])))
    return out


def _blocks(docs: DataFrame, cut: Callable[[bytes], list[tuple[int, str, str]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, c in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()) if c is not None for x in cut(c)]
            cols = [list(c) for c in zip(*rows)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "position", "heading", "text"])

    found = map_arrow(docs.select("doc_id", "content"), run, "doc_id string, position int, heading string, text string")
    return chunking._finish(found.select("doc_id", "position", "text", F.array("heading").alias("heading_path")))


@register("pptx", ("pptx",), "application/vnd.openxmlformats-officedocument.presentationml.presentation", True)
def _pptx(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return _blocks(docs, pptx_slides)


@register("xlsx", ("xlsx", "xls"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", True)
def _xlsx(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return _blocks(docs, sheet_blocks)
