"""Comparing a query with its SQL, run by DuckDB on the same Parquet files."""

import os
from decimal import Decimal

import duckdb

FOLDER = "/root/testdata/sf0.001"


def canon(x):
    if isinstance(x, float | Decimal):
        return ("number", round(float(x), 6))
    if isinstance(x, list | tuple):
        return tuple(canon(v) for v in x)
    return x


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(canon(r[n]) for n in names)) for r in table.to_pylist())


def same(spark, query, sql, folder=FOLDER):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(sql).to_arrow_table()
    got = query(spark, folder).toArrow()
    assert rows(got) == rows(want)
