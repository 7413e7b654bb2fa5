"""Run a query and its SQL twin on the same tables and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    """A value without engine-specific types; doubles to 9 digits."""
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if hasattr(x, "asDict"):
        return tuple(plain(i) for i in x.asDict().values())
    if isinstance(x, dict):
        return tuple(plain(i) for i in x.values())
    return x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if the results agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only ours {list((mine - theirs).items())[:3]}; only theirs {list((theirs - mine).items())[:3]}"
    return ""
