"""Compare queries with their DuckDB oracles the way the driver does."""

from __future__ import annotations

import math

import duckdb

from tessella.plans.dialect import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    got = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {got.columns} and {names}"
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if len(have) != len(want):
        return f"{len(have)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    return f"{len(bad)} of {len(want)} rows differ: {bad[:2]}" if bad else None
