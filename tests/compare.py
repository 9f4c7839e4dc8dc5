"""Running a query and its SQL on the same tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(df, con, sql: str) -> None:
    want = con.sql(sql)
    columns, rows = want.columns, want.fetchall()
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in rows), key=repr)
    assert a == b
