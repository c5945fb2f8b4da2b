"""Every registered query runs over whole tables; those with SQL give what DuckDB gives."""

import struct

import duckdb
import pytest
from oracle import expected, got

from lexigrid.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert got(QUERIES[name](spark, sf)) == expected(SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_flagship_cites_five_chunks_for_each_question(spark, sf):
    rows = registry.flagship(spark, sf).groupBy("query_id").count().collect()
    assert len(rows) == 40 and {r["count"] for r in rows} == {5}


def test_flagship_writes_no_vectors(spark, sf, monkeypatch):
    from lexigrid.plans import store_queries

    written, write = [], store_queries.materialise
    monkeypatch.setattr(store_queries, "materialise", lambda df, label: written.append(df.dtypes) or write(df, label))
    assert registry.flagship(spark, sf).count() == 200
    assert written and not any(kind == "array<float>" for columns in written for _, kind in columns)


def test_reranking_knows_how_few_candidates_there_are(spark, sf, monkeypatch):
    from lexigrid.plans import store_queries

    labels, write = [], store_queries.materialise
    monkeypatch.setattr(store_queries, "materialise", lambda df, label: labels.append(label) or write(df, label))
    assert QUERIES["cross_encoder_rerank"](spark, sf).count() > 0 and labels == ["bm25"]


def test_fn_array_rounds_as_duckdb_does(spark, tmp_path):
    values = [[-1e-5, 1e-5, -0.0], [0.000025, -0.000025, 0.00007500000356230885], [0.123475, -2.5, 0.0]]
    spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = {i: t for i, t, *_ in c.execute(SQL["fn_array"]).fetchall()}
    found = {r["vec_id"]: r["t"] for r in QUERIES["fn_array"](spark, str(tmp_path)).collect()}
    bits = lambda x: {i: [struct.pack("d", v) for v in t] for i, t in x.items()}
    assert bits(found) == bits(want)  # -0.0 and 0.0 are equal, their bits aren't
