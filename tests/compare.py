"""Runs a query in Spark and its SQL in DuckDB, and compares the rows without regard to order."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return str(x) if hasattr(x, "isoformat") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs first."""
    df = query(spark, sf_dir)
    names, ours = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    other_names, theirs = rows([d[0] for d in found.description], found.fetchall())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")
