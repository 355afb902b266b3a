"""Comparison of a query with its SQL."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(sf_dir=DATA):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def key(row):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def assert_same(spark, query, sql, sf_dir=DATA):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [[v.asDict(True) if hasattr(v, "asDict") else v for v in r] for r in df.collect()])
    result = connection(sf_dir).execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b
