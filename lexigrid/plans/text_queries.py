"""Sources and chunking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import chunking
from lexigrid.plans.base import CHUNKS, chunks, documents, table
from lexigrid.plans.registry import query
from lexigrid.sources import files

MARKDOWN = f"md AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, {T.sql_html_to_markdown('html')} AS text FROM pages)"
SECTIONS = (
    MARKDOWN
    + r""",
lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM md) t, unnest(range(1, len(ls) + 1)) u(i)),
marked AS (SELECT *, length(regexp_extract(line, '^(#{1,6})[ \t]+(\S.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})[ \t]+(\S.*)$', 2), ' ') AS title FROM lines),
placed AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM marked),
raw AS (
  SELECT doc_id, s, max(level) AS level, coalesce(max(CASE WHEN level > 0 THEN title END), '') AS title,
         regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS body
  FROM placed GROUP BY doc_id, s),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS section, level, title, body FROM raw WHERE level > 0 OR body <> ''),
paths AS (
  SELECT x.doc_id, x.section, x.level, x.title, x.body,
         coalesce((SELECT list(a.title ORDER BY a.section) FROM sections a WHERE a.doc_id = x.doc_id AND a.level > 0 AND a.section <= x.section
           AND NOT EXISTS (SELECT 1 FROM sections b WHERE b.doc_id = a.doc_id AND b.section > a.section AND b.section <= x.section AND b.level > 0 AND b.level <= a.level)), []) AS heading_path
  FROM sections x)"""
)


def _markdown(spark, d):
    """Markdown of each page, with a made-up second level so that breadcrumbs have depth."""
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), T.html_to_markdown(F.col("html")).alias("text"))


@query("doc_identity", "SELECT left(sha256(text), 16) AS doc_key, sha256(text) AS content_hash, source AS title, doc_id FROM documents")
def doc_identity(spark, d):
    t = documents(spark, d)
    return t.select(F.substring("content_hash", 1, 16).alias("doc_key"), "content_hash", "title", F.col("doc_id").cast("long").alias("doc_id"))


@query(
    "parser_registry",
    """SELECT page_id, CASE WHEN ext IN ('md', 'mdx', 'markdown') THEN 'markdown' WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'docx' THEN 'docx'
WHEN ext = 'pptx' THEN 'pptx' WHEN ext IN ('xlsx', 'xls') THEN 'xlsx' WHEN ext IN ('png', 'jpg', 'jpeg', 'tiff', 'tif', 'bmp', 'webp') THEN 'image' ELSE 'text' END AS parser
FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)""".replace("\\\\", "\\"),
)
def parser_registry(spark, d):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", files.parser_of(path).alias("parser"))


@query("src_text", f"WITH {CHUNKS} SELECT chunk_id, doc_id, position, text, token_count FROM chunks")
def src_text(spark, d):
    return chunks(spark, d)


@query(
    "chunk_words",
    r"""SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(p AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(p AS INTEGER) AS position,
array_to_string(w[p * 1100 + 1 : p * 1100 + 1200], ' ') AS text, len(w[p * 1100 + 1 : p * 1100 + 1200]) AS token_count
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) d, unnest(range(0, (len(w) + 1099) // 1100)) u(p)""",
)
def chunk_words(spark, d):
    return chunking.chunk_words(table(spark, d, "documents"))


@query("src_html", f"WITH {MARKDOWN} SELECT doc_id, text FROM md")
def src_html(spark, d):
    return _markdown(spark, d)


@query("split_sections", f"WITH {SECTIONS} SELECT doc_id, section, level, title, body FROM sections")
def split_sections(spark, d):
    return chunking.split_sections(_markdown(spark, d)).drop("heading_path")


@query("heading_path", f"WITH {SECTIONS} SELECT doc_id, section, heading_path FROM paths")
def heading_path(spark, d):
    return chunking.split_sections(_markdown(spark, d)).select("doc_id", "section", "heading_path")


_CHUNK_SECTIONS = (
    f"WITH {SECTIONS}"
    + r""", w AS (SELECT doc_id, section, heading_path, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS w FROM paths),
c AS (SELECT doc_id, section, p, heading_path, array_to_string(w[p * 100 + 1 : p * 100 + 120], ' ') AS text, len(w[p * 100 + 1 : p * 100 + 120]) AS token_count FROM w, unnest(range(0, (len(w) + 99) // 100)) u(p)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, p) - 1 AS position FROM c)
SELECT doc_id || ':' || CAST(position AS VARCHAR) AS chunk_id, doc_id, position, text, heading_path, token_count FROM n"""
)


@query("chunk_sections", _CHUNK_SECTIONS)
def chunk_sections(spark, d):
    return chunking.chunk_sections(_markdown(spark, d), 120, 20)


@query("src_markdown", _CHUNK_SECTIONS)
def src_markdown(spark, d):
    return files.parse("markdown", _markdown(spark, d), 120, 20)


@query(
    "src_xlsx",
    """WITH n AS (SELECT l_returnflag AS doc_id, CAST(l_orderkey AS VARCHAR) || ' | ' || CAST(l_linenumber AS VARCHAR) || ' | ' || l_linestatus AS t,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
g AS (SELECT doc_id, i // 50 AS position, string_agg(t, chr(10) ORDER BY i) AS text, sum(len(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS token_count FROM n GROUP BY ALL)
SELECT doc_id || ':' || CAST(position AS VARCHAR) AS chunk_id, doc_id, position, text, token_count FROM g""",
)
def src_xlsx(spark, d):
    t = table(spark, d, "lineitem")
    cells = F.concat_ws(" | ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus")
    return chunking.group_rows(t, cells, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_returnflag"))


@query("token_count", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS token_count FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("token_count"))


@query("split_sentences")
def split_sentences(spark, d):
    """No SQL: RE2 has no look-behind."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query(
    "truncate_text",
    r"""SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text ELSE trim(CASE WHEN cut <> '' THEN cut ELSE left(text, 12000) END, ' ') END AS text
FROM (SELECT doc_id, text, regexp_extract(left(text, 12001), '(?s)^.*\. ', 0) AS cut FROM documents)""",
)
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 12000).alias("text"))


@query(
    "title_clip",
    "SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN 'Untitled Topic' WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS title FROM documents",
)
def title_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip_title(F.col("text")).alias("title"))


@query("text_excerpt", "SELECT doc_id, left(text, 300) AS text_excerpt FROM documents")
def text_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("text_excerpt"))


@query("concat_ordered", "SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents WHERE text <> '' GROUP BY source")
def concat_ordered(spark, d):
    from lexigrid.operators.topics import concat_ordered

    return concat_ordered(table(spark, d, "documents").withColumn("position", F.lit(0)), ["source"])


@query(
    "coref_canonicalize",
    r"SELECT p_partkey, regexp_replace(lower(trim(p_name || '.', ' ')), '[^\w\s]', '', 'g') AS canonical FROM part",
)
def coref_canonicalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.canonical_name(F.concat("p_name", F.lit("."))).alias("canonical"))


@query(
    "token_jaccard",
    """WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, list_distinct(string_split(p_name, ' ')) AS w FROM n)
SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9) AS jaccard FROM t a JOIN t b ON a.p_name < b.p_name""",
)
def token_jaccard(spark, d):
    n = table(spark, d, "part").select("p_name").distinct()
    pairs = n.alias("x").join(n.alias("y"), F.col("x.p_name") < F.col("y.p_name"))
    return pairs.select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b"), F.round(T.token_jaccard(F.col("x.p_name"), F.col("y.p_name")), 9).alias("jaccard"))


@query(
    "embedding_text",
    "SELECT p_partkey, p_name || ' This is a ' || p_type AS embedding_text FROM part",
)
def embedding_text(spark, d):
    from lexigrid.operators.embed import embedding_text

    t = table(spark, d, "part").select("p_partkey", F.lit("ENTITY").alias("node_type"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lit(None).cast("string").alias("text"))
    return t.select("p_partkey", embedding_text().alias("embedding_text"))
