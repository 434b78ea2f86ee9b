"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(names: list[str], found) -> Counter:
    return Counter(tuple(str(r[k]) for k in names) for r in found)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> bool:
    own = sorted(df.columns)
    theirs = con.execute(sql)
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == own
    wanted = rows(own, (dict(zip(columns, r, strict=True)) for r in theirs.fetchall()))
    return rows(own, (r.asDict() for r in df.collect())) == wanted
