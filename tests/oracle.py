"""Compare a query with its SQL, the way rows compare as sets of typed values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x + 0.0:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def rows_of_frame(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
