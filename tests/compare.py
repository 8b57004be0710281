"""Rows of a query against rows of its SQL."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


def normalised(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, connection, sql: str) -> str:
    """'' if both give the same columns and rows."""
    names, got = normalised([tuple(r) for r in df.collect()], df.columns)
    cursor = connection.execute(sql)
    other, expected = normalised(cursor.fetchall(), [x[0] for x in cursor.description])
    if names != other:
        return f"columns {names} and {other}"
    if got == expected:
        return ""
    odd = [(a, b) for a, b in zip(got, expected) if a != b]
    return f"rows {len(got)} and {len(expected)}, {len(odd)} differ: {odd[:2]}"
