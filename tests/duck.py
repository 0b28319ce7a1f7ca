"""Holds a query against its SQL in DuckDB over the tables of a folder."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem documents benchmark labels embeddings pages conversations events".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_equal(spark, folder, query, sql):
    df = query(spark, folder)
    con = connect(folder).execute(sql)
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, con.fetchall())
