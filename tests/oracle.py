"""Runs a query and its DuckDB counterpart over the same folder."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark, folder, query, sql):
    frame = query(spark, folder)
    names = sorted(frame.columns)
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = base.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    got = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
