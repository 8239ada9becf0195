"""Spark results against DuckDB's for the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    columns = sorted(names)
    return columns, sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
