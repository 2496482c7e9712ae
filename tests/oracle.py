"""Compare a registered query with its SQL: names, row count, values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, name, run, sql, sf_dir):
    """None when both agree, else a short account of how they differ."""
    df = run(spark, sf_dir)
    mine = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if len(a) != len(b):
        return f"{name}: {len(a)} vs {len(b)} rows; only mine {sorted(set(a) - set(b), key=repr)[:2]} only theirs {sorted(set(b) - set(a), key=repr)[:2]}"
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{name}: {sum(x != y for x, y in zip(a, b))} of {len(a)} rows differ: {only}"
    if not a:
        return f"{name}: both empty"
    return None
