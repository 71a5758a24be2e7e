"""Run a named query and its SQL on the same tables and compare the results as sets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

import __spark_entry__ as entry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    df = entry.queries()[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    want_columns, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got_columns == want_columns, (name, got_columns, want_columns)
    assert got == want, (name, sum(got.values()), sum(want.values()), list((got - want))[:3], list((want - got))[:3])
    return sum(got.values())
