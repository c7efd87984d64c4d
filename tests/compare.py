"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def oracle(d: str):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if got == want:
        kinds = {k: (t, str(u)) for (k, t), (_, u) in zip(sorted(df.dtypes), sorted(zip(rel.columns, rel.types)), strict=True)}
        alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        odd = {k: v for k, v in kinds.items() if alike.get(v[0], v[1]) != v[1]}
        return f"types {odd}" if odd else ""
    only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; {only}"
