"""Rows of a query against the rows of its SQL."""

import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 9) + 0.0
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    return columns, sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
