"""Rows of Spark and DuckDB in one comparable form."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        f = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def plain(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    columns = sorted(names)
    return columns, sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
