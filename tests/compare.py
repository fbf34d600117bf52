"""Order-insensitive comparison of a Spark result with DuckDB over the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "item"):
        return canon(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def diff(df, con, sql):
    """None when equal, else a short description."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([x[0] for x in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}", len(sr)
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}\n  spark-only {[r for r in sr if r not in set(dr)][:2]}\n  duck-only {[r for r in dr if r not in set(sr)][:2]}"[:3000], len(sr)
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first:\n  {str(bad[0][0])[:900]}\n  {str(bad[0][1])[:900]}", len(sr)
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(sc, sr[0], dr[0]) if type(a) is not type(b)] if sr else []
    return (f"types differ {types}" if types else None), len(sr)
