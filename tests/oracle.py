"""Side-by-side comparison of registered queries with their SQL."""

import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def connect(root):
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, root, query, sql):
    frame = query(spark, root)
    names = sorted(frame.columns)
    got = sorted(repr(tuple(plain(row[n]) for n in names)) for row in frame.collect())
    cursor = connect(root).execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = sorted(repr(tuple(plain(row[k]) for k in order)) for row in cursor.fetchall())
    assert got == want
