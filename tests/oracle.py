"""Compares a Spark query with its SQL in DuckDB: names, rows and values, in any order."""

import datetime as dt
import decimal
import glob
import os

import duckdb


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, dt.date) else v


def _norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        t = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def same(spark, fn, sql, sf):
    df = fn(spark, sf)
    got = _norm(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(sql)
    want = _norm([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    assert got[1] == want[1], next((g, w) for g, w in zip(got[1], want[1], strict=True) if g != w)
