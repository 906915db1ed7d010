"""Comparison of a Spark result with SQL run by DuckDB on the same files."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v + 0:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    cols = [map(plain, table.column(n).to_pylist()) for n in names]
    return names, sorted(zip(*cols))


def assert_same(df, con, sql):
    result = con.execute(sql).fetch_arrow_table() if hasattr(con, "fetch_arrow_table") else con.sql(sql).to_arrow_table()
    got, want = rows(df.toArrow()), rows(result)
    assert got[0] == want[0]
    assert got[1] == want[1], (list(set(got[1]) - set(want[1]))[:3], list(set(want[1]) - set(got[1]))[:3])
