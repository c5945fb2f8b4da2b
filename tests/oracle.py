"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, (str, bytes)) else str(v)


def expected(sql, folder):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        cur = c.execute(sql)
        names = [x[0] for x in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def got(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
