"""Rows of Spark and DuckDB results in one comparable form."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in (t for t in TABLES if os.path.exists(f"{sf_dir}/{t}.parquet")):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet' || '{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), ordered(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
