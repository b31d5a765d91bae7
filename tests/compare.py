"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

from areascope.queries import QUERIES
from areascope.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    return value


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: [(v is None, str(v)) for v in t])


def compare(spark, con, name: str, folder: str) -> tuple[str, float, int]:
    q = QUERIES[name]
    start = time.time()
    df = q.build(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if q.sql is None:
        return ("rows only" if rows else "EMPTY"), seconds, len(rows)
    cur = con.execute(q.sql)
    columns = [c[0] for c in cur.description]
    want_cols, want = table_rows(columns, cur.fetchall())
    got_cols, got = table_rows(df.columns, rows)
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", seconds, len(rows)
    if not rows and not want:
        return "EMPTY", seconds, 0
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", seconds, len(rows)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"VALUES {len(bad)} differ, e.g. {bad[0]}", seconds, len(rows)
    return "ok", seconds, len(rows)
