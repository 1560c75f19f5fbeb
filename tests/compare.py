"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, str)) else str(v) if not hasattr(v, "as_integer_ratio") else round(float(v), 6)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def of_duck(folder, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted(names), rows(names, out.fetchall())


def of_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())
