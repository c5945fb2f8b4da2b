"""Graph tables on disk: Parquet in, Parquet, GraphML or JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.operators.upsert import clean_properties

TABLES = {
    "documents": "doc_id string, title string, source_path string, mime_type string, content_hash string, created_at timestamp, chunk_count int",
    "chunks": "chunk_id string, doc_id string, position int, text string, heading_path array<string>, token_count int, embedding array<float>",
    "entities": "entity_id string, name string, type string, llm_type string, description string, aliases array<string>, community_id string, embedding array<float>",
    "edges": "src string, dst string, src_label string, dst_label string, rel string, relation_type string, weight double, scope_id string, source string",
    "topics": "id string, node_type string, title string, summary string, chunk_ids array<string>, entity_ids array<string>, has_summary boolean",
}
KEYS = {"documents": ["doc_id"], "chunks": ["chunk_id"], "entities": ["entity_id"], "edges": ["src", "rel", "dst", "relation_type", "scope_id"], "topics": ["id"]}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of a graph table, missing ones null."""
    schema = T._parse_datatype_string(TABLES[table])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _places(spark: SparkSession, folder: str, table: str):
    """The file system, and where a table, its next version and its former one are."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    to, new, old = (path(f"{folder}/{n}") for n in (table, f"_{table}.new", f"_{table}.old"))
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to, new, old


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {a.toString()} to {b.toString()}")


def write(df: DataFrame, folder: str, table: str) -> None:
    """Overwrite a table. Its next version is written beside it first, since it may be read from the old one.

    The former version goes only once the next one is in place: after a crash in between ``read`` finds it.
    """
    fs, to, new, old = _places(df.sparkSession, folder, table)
    fs.delete(new, True)
    conform(df, table).write.parquet(new.toString())
    if fs.exists(to):
        fs.delete(old, True)
        _rename(fs, to, old)
    _rename(fs, new, to)
    fs.delete(old, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A graph table, or the former version of one whose exchange was cut short; an empty one where nothing was written yet."""
    fs, to, _, old = _places(spark, folder, table)
    for p in (to, old):
        if fs.exists(p):
            return spark.read.schema(TABLES[table]).parquet(p.toString())
    return spark.createDataFrame([], TABLES[table])


def clean(spark: SparkSession, folder: str) -> None:
    for table in TABLES:
        write(spark.createDataFrame([], TABLES[table]), folder, table)


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """``(table, problem, rows)`` of null and repeated keys in node tables: what uniqueness constraints would refuse."""
    out = None
    for table in ("documents", "chunks", "entities"):
        key = KEYS[table][0]
        t = read(spark, folder, table)
        n = t.agg(F.count_if(F.col(key).isNull()).alias("nulls"), (F.count(key) - F.countDistinct(key)).alias("repeats"))
        part = n.select(F.lit(table).alias("table"), F.explode(F.map_from_arrays(F.array(F.lit("null"), F.lit("repeated")), F.array("nulls", "repeats"))).alias("problem", "rows")).where("rows > 0")
        out = part if out is None else out.unionByName(part)
    return out


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def graphml_elements(df: DataFrame, element: str, key: list[str]) -> DataFrame:
    """``(line)``: one XML element for each row, null properties left out."""
    clean_ = clean_properties(df)
    data = [
        F.when(F.col(f"`{f.name}`").isNotNull(), F.concat(F.lit(f'<data key="{f.name}">'), _escaped(F.col(f"`{f.name}`").cast("string")), F.lit("</data>")))
        for f in clean_.schema.fields
        if f.name not in key
    ]
    if element == "node":
        head = F.concat(F.lit('<node id="'), _escaped(F.col(key[0])), F.lit('">'))
    else:
        head = F.concat(F.lit('<edge source="'), _escaped(F.col(key[0])), F.lit('" target="'), _escaped(F.col(key[1])), F.lit('">'))
    return clean_.select(F.concat(head, F.concat_ws("", *data), F.lit(f"</{element}>")).alias("line"))


def export_graphml(nodes: DataFrame, edges: DataFrame, folder: str, node_key: str = "id") -> None:
    """Part files that, in the order of their folders, make one GraphML document: head, nodes, edges, tail. No single task writes the graph."""
    spark = nodes.sparkSession
    names = dict.fromkeys([c for c in nodes.columns if c != node_key] + [c for c in edges.columns if c not in ("src", "dst")])
    keys = "".join(f'<key id="{n}" for="all" attr.name="{n}" attr.type="string"/>' for n in names)
    head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    for name, lines in (
        ("0-head", spark.createDataFrame([(head,)], "line string").coalesce(1)),
        ("1-nodes", graphml_elements(nodes, "node", [node_key])),
        ("2-edges", graphml_elements(edges, "edge", ["src", "dst"])),
        ("3-tail", spark.createDataFrame([("</graph></graphml>",)], "line string").coalesce(1)),
    ):
        lines.write.mode("overwrite").text(f"{folder}/{name}")


def export_schema(profile: DataFrame, folder: str) -> None:
    """A profile as JSON lines."""
    profile.select(F.to_json(F.struct(*profile.columns)).alias("value")).write.mode("overwrite").text(folder)
