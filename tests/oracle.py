"""Runs a query and its DuckDB text over the same tables and compares whole results."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql)
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns), (sorted(cols), sorted(df.columns))
    a, b = rows_of(df.columns, df.collect()), rows_of(cols, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
    return len(a)
