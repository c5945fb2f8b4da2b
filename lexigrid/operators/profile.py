"""Schema profiles of graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def type_name(t: T.DataType, length: int | None = None) -> str:
    """Name of a property's type; lists of floats longer than 10 are embeddings."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.FractionalType) and (length or 0) > 10:
            return f"embedding[{length}]"
        return f"list[{type_name(t.elementType)}]"
    return t.typeName()


def _typed(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FractionalType):
        name = F.when(F.size(c) > 10, F.format_string("embedding[%d]", F.size(c))).when(F.size(c) > 0, F.lit(type_name(f.dataType))).otherwise(F.lit("list"))
    else:
        name = F.lit(type_name(f.dataType))
    return F.when(c.isNotNull(), F.struct(F.lit(f.name).alias("property"), name.alias("type")))


def properties(df: DataFrame, by: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """``(by, count, property, type)``: rows of each kind, and the properties that any of them has. One pass, partial sums on the map side."""
    fields = [f for f in df.schema.fields if f.name != by and f.name not in skip]
    kinds = df.select(F.col(by), *[_typed(f).alias(f"_p{i}") for i, f in enumerate(fields)])
    agg = kinds.groupBy(by).agg(F.count(F.lit(1)).alias("count"), *[F.min(f"_p{i}").alias(f"_p{i}") for i in range(len(fields))])
    listed = F.filter(F.array(*[F.col(f"_p{i}") for i in range(len(fields))]), lambda x: x.isNotNull())
    return agg.select(by, "count", F.explode_outer(listed).alias("p")).select(by, "count", "p.property", "p.type")


def edge_profile(edges: DataFrame, nodes: DataFrame, label: str = "rel", node_type: str = "node_type") -> DataFrame:
    """``(rel, count, source_types, target_types)``. Ends are counted before they meet their nodes, so edges themselves aren't moved."""
    n = nodes.select("id", F.coalesce(node_type, F.lit("UNKNOWN")).alias("t"))
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"))))
    e = edges.select(label, ends.alias("end")).groupBy(label, "end.id", "end.out").agg(F.count(F.lit(1)).alias("n"))
    typed = e.join(n, "id", "left")
    types = lambda out: F.sort_array(F.collect_set(F.when(out, F.col("t"))))
    return typed.groupBy(label).agg(F.sum(F.when(F.col("out"), F.col("n"))).alias("count"), types(F.col("out")).alias("source_types"), types(~F.col("out")).alias("target_types"))


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, each counted on its own."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
