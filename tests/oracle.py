"""Holding a query's rows against DuckDB's for its oracle SQL."""

import math
from decimal import Decimal

import duckdb

from tidemark.plans.registry import TABLES


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def same(con, df, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    assert got == want
