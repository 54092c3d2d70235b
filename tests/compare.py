"""Rows of a query and of its SQL, compared without regard to order."""

import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)
