"""DuckDB side of the checks: the given tables as views, and order-free comparison."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{os.path.join(folder, name)}.parquet')")
    return con


def duck_rows(con, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def normal(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value
