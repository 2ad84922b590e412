"""Row-set comparison of a Spark query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal, int)):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def spark_rows(df):
    return row_set(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return row_set([d[0] for d in cursor.description], cursor.fetchall())


def difference(df, con, sql) -> str | None:
    (c1, r1), (c2, r2) = spark_rows(df), sql_rows(con, sql)
    if c1 != c2:
        return f"columns differ: {c1} / {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows / {len(r2)} rows; first spark {r1[:2]} sql {r2[:2]}"
    if not r1:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(c1, a, b) if x != y]
        return f"{len(bad)} of {len(r1)} rows differ; first: {cells} in {a}"
    return None
