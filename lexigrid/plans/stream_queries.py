"""Streams over the event table, and what else the services do around queries."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from lexigrid.operators import chunking
from lexigrid.plans.base import CHUNKS, OVERLAP, SIZE, table
from lexigrid.plans.registry import query
from lexigrid.sources import files
from lexigrid.storage import shared_dir
from lexigrid.streaming import events as S
from lexigrid.streaming.ingest import run_to_table, watch
from lexigrid.streaming.jobs import track


def _stream(spark, d, name="events"):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(_folder(d, name))


def _folder(d, name):
    """A pattern, as a table may be one file or a folder of files."""
    return f"{d}/{name}.parquet*"


@query("stream_tumbling", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = run_to_table(S.tumbling(_stream(spark, d)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT CAST(date_trunc('hour', ts) - to_hours(k) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return run_to_table(S.sliding(_stream(spark, d)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_session",
    """WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark, d):
    return run_to_table(S.sessions(_stream(spark, d)), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark, d):
    """Every event arrives twice."""
    twice = _stream(spark, d).withColumn("_i", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_i")
    return run_to_table(S.deduplicated(twice)).select("event_id", "event_type")


@query("stream_late")
def stream_late(spark, d):
    """Windows that the watermark has closed, in append mode; what is younger than it is still open. The tests send late rows."""
    return run_to_table(S.tumbling(_stream(spark, d))).select("start", "event_type", "n")


@query("stream_ingest", f"WITH {CHUNKS} SELECT chunk_id, doc_id, position, text, token_count FROM chunks")
def stream_ingest(spark, d):
    """Documents as a stream of files, chunked as they arrive."""
    rows = watch(spark, _folder(d, "documents"), table(spark, d, "documents").schema.simpleString()[7:-1].replace(":", " "))
    return run_to_table(chunking.chunk_words(rows, SIZE, OVERLAP))


@query("job_queue", "SELECT o_custkey AS job_id, 'done' AS status, 1.0::DOUBLE AS progress FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0")
def job_queue(spark, d):
    """A job for each customer; an order filled is its end. What the stream says of finished jobs."""
    s = _stream(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("o_orderstatus") == "P", F.lit("resolving")).otherwise(F.lit("extracting")).alias("status"))
    return run_to_table(track(s), "update").where("status = 'done'")


def _input(spark, d):
    """A folder with a file of each text format, written from the driver's tables."""
    home = f"{shared_dir(spark)}/tables/input-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put(name: str, data: bytes) -> None:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{home}/{name}"))
        out.write(bytearray(data))
        out.close()

    put("note.txt", b"one two three")
    put(".hidden", b"never seen")
    put("deep.md", b"intro\n# A\na\n## B\nb\n# C\nc\n")
    put("page.html", b"<html><head><title>t</title></head><body><h1>Head</h1><p>body text</p></body></html>")
    put("word.docx", office({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some words</w:t></w:r></w:p></w:document>'}))
    put("talk.pptx", office({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:t>First</a:t></a:p></p:sp><p:sp><a:p><a:t>said</a:t></a:p></p:sp></p:sld>'}))
    put("book.xlsx", office({"xl/workbook.xml": '<w xmlns:r="r"><sheet name="Data"/></w>', "xl/worksheets/sheet1.xml": "<ws><row><c><v>1</v></c><c><v>2</v></c></row><row/></ws>"}))
    put("scan.pdf", b"%PDF")
    return home


def office(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return buffer.getvalue()


@query("scan_dir")
def scan_dir(spark, d):
    return files.identify(files.scan_dir(spark, _input(spark, d))).select("name", "length", "title", "parser", "mime_type", "doc_id")


def _of(parser):
    def run(spark, d):
        found = files.identify(files.scan_dir(spark, _input(spark, d))).where(F.col("parser") == parser)
        return files.parse(parser, found.select("doc_id", "content")).select("position", "text", "heading_path")

    return run


query("src_docx", "SELECT 0 AS position, 'Some words' AS text, ['Title'] AS heading_path")(_of("docx"))
query("src_pptx", "SELECT 0 AS position, 'said' AS text, ['Slide 1: First'] AS heading_path")(_of("pptx"))
query("src_pdf", "SELECT 0 AS position, '' AS text, ['x'] AS heading_path WHERE false")(_of("pdf"))


@query("src_image", "SELECT 0 AS position, '' AS text WHERE false")
def src_image(spark, d):
    """No OCR reader is registered, so images give no chunks."""
    none = spark.createDataFrame([("i", bytearray(b"x"))], "doc_id string, content binary")
    return files.parse("image", none).select("position", "text")


@query("upload_one")
def upload_one(spark, d):
    from lexigrid.engine import Engine

    e = Engine(spark, f"{shared_dir(spark)}/tables/graph-{uuid.uuid4().hex}")
    doc_id = e.upload(f"{_input(spark, d)}/note.txt")
    return e.document(doc_id).select("doc_id", "title", F.size("chunks").alias("chunks"))


@query("sse_stream")
def sse_stream(spark, d):
    """Events of one answer: tokens, citations, graph, done."""
    from lexigrid.engine import Engine

    e = Engine(spark, f"{shared_dir(spark)}/tables/graph-{uuid.uuid4().hex}")
    e.upload(f"{_input(spark, d)}/note.txt")
    kinds = [(i, x["type"]) for i, x in enumerate(e.stream("two three"))]
    return spark.createDataFrame(kinds, "seq int, type string")


@query("run_graph")
def run_graph(spark, d):
    """A whole run over a folder: how many rows each graph table has."""
    from lexigrid.engine import Engine

    e = Engine(spark, f"{shared_dir(spark)}/tables/graph-{uuid.uuid4().hex}")
    return spark.createDataFrame(sorted(e.run(_input(spark, d), clean_database=True).items()), "name string, n long")
