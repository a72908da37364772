"""Rows of a Spark query beside those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir, f"{table}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs; empty if nothing does."""
    names, ours = rows_of(df.columns, df.collect())
    con.execute(sql)
    others, theirs = rows_of([d[0] for d in con.description], con.fetchall())
    if names != others:
        return f"columns {names} and {others}"
    if ours == theirs:
        return ""
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"{len(ours)} and {len(theirs)} rows; ours only {len(a)} {sorted(a, key=repr)[:3]}, theirs only {len(b)} {sorted(b, key=repr)[:3]}"[:900]
