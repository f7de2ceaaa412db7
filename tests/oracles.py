"""Rows of a Spark result and of its DuckDB SQL in one normal form."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime | date):
        return str(x)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x if isinstance(x, int | str) else str(x)


def rows(names: list[str], found: list) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def of_spark(df):
    return rows(df.columns, df.collect())


def of_sql(con: duckdb.DuckDBPyConnection, sql: str):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows(names, got.fetchall())
