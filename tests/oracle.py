"""Run a query and its SQL side by side and describe any difference."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=_key)


def compare(spark, con, sf_dir, fn, sql) -> list[str]:
    """Empty when the two results hold exactly the same rows."""
    df = fn(spark, sf_dir)
    s_names, s_rows = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    d_names, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    faults = []
    if s_names != d_names:
        return [f"columns differ: {s_names} vs {d_names}"]
    if len(s_rows) != len(d_rows):
        faults.append(f"row counts differ: {len(s_rows)} vs {len(d_rows)}")
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        faults.append(f"{len(bad)} of {len(s_rows)} rows differ, first: {bad[0][0]} vs {bad[0][1]}")
    kinds = [
        (n, type(a).__name__, type(b).__name__)
        for n, col_a, col_b in zip(s_names, zip(*s_rows), zip(*d_rows))
        for a, b in [(next((x for x in col_a if x is not None), None), next((x for x in col_b if x is not None), None))]
        if type(a) is not type(b)
    ] if s_rows and d_rows else []
    if kinds:
        faults.append(f"types differ: {kinds}")
    return faults
