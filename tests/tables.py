"""Small tables in a folder, and a query over them held against its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd

import __spark_entry__ as entry

from .compare import of_spark, rows


def write(folder, **tables):
    for name, data in tables.items():
        pd.DataFrame(data).to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def both(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in out.description]
    return of_spark(entry.queries()[name](spark, folder)), (sorted(names), rows(names, out.fetchall()))
