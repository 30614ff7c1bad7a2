"""Runs a query on Spark and its SQL on DuckDB and names the columns that differ."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


def close(a, b, loose: float) -> bool:
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= loose * max(1.0, abs(a), abs(b))
    return False


def order(row):
    return tuple((v is None, str(type(v)), round(v, 3) if isinstance(v, float) else v) if not isinstance(v, (int, bool)) else (False, "<class 'float'>", float(v)) for v in row)


def differences(spark, sf: str, query, sql: str, loose: float = 0.0) -> list[str]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    if names != sorted(got.columns):
        return [f"columns {sorted(got.columns)} and {names}"]
    at = [[d[0] for d in want.description].index(n) for n in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=order)
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.select(*(f"`{n}`" for n in names)).collect()), key=order)
    if len(a) != len(b):
        return [f"{len(a)} rows and {len(b)}"]
    bad = []
    for i, n in enumerate(names):
        off = [(x[i], y[i]) for x, y in zip(a, b, strict=True) if not close(x[i], y[i], loose)]
        if off:
            bad.append(f"{n}: {len(off)} of {len(a)} differ, such as {off[:3]}")
    return bad
