"""Run a query and its DuckDB counterpart over the same tables and compare their rows."""

import glob
import math
import os

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "asDict"):
        return tuple(map(_plain, v))
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(map(_plain, v.values()))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def assert_same(spark, query, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, cursor.fetchall())
    return got
