"""Hold a Spark query against its SQL in DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, query, sql: str, sf_dir: str):
    """(columns only in one, rows only in Spark, rows only in SQL, number of rows)."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    columns = [c[0] for c in rel.description]
    theirs = rows(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return sorted(set(columns) ^ set(df.columns)), [], [], len(mine)
    a, b = {}, {}
    for r in mine:
        a[r] = a.get(r, 0) + 1
    for r in theirs:
        b[r] = b.get(r, 0) + 1
    return [], [r for r in a if a[r] != b.get(r, 0)], [r for r in b if b[r] != a.get(r, 0)], len(mine)
