"""Comparison of a Spark result with an oracle's, apart from the order of rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs first, or nothing."""
    cur = con.execute(sql)
    names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    mine, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if mine != names:
        return f"columns {mine}, oracle {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}; {[r for r in got if r not in set(want)][:2]} {[r for r in want if r not in set(got)][:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) or isinstance(y, float) and isinstance(x, int) and x == y for x, y in zip(a, b, strict=True)):
            return f"row {a}, oracle {b}"
    return ""
