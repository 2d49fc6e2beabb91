"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows as multisets."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if alike, else what differs."""
    df = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    left = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    right = sorted((tuple(value(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    if left == right:
        return ""
    only_l = [r for r in left if r not in set(right)][:3]
    only_r = [r for r in right if r not in set(left)][:3]
    return f"{len(left)} and {len(right)} rows; {order}; Spark alone {only_l}; SQL alone {only_r}"
