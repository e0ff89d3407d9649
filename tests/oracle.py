"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from ferrule.sources.tables import NAMES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(name: str, query, sql: str, spark, folder: str, con=None) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    rel = (con or connect(folder)).execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows_of(names, rel.fetchall())
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} rows, SQL has {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{name}: {len(bad)} rows differ, first {bad[0][0][:300]} and {bad[0][1][:300]}" if bad else None
