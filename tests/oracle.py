"""Compare queries with their SQL in DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        at = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(at):
            files = f"{at}/*.parquet" if os.path.isdir(at) and glob.glob(f"{at}/*.parquet") else at
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """What differs, or None."""
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    theirs, ours = _rows(columns, want.fetchall()), _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(theirs) != len(ours):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return None
