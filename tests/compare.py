"""Rows of a Spark result against those of DuckDB."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def same(df, sql, sf):
    found = connect(sf).execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    mine = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    its = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in found.fetchall())
    assert mine == its
