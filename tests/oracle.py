"""Runs a query and its SQL on the same tables and compares them as multisets of rows."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(clean, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def same(spark, query, sql, sf_dir=SF):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert rows(got) == rows(want)
