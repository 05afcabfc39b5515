"""Results of Spark against DuckDB over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return db


def cell(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(db, sql):
    got = db.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(cell(r[i]) for i in at) for r in got.fetchall()), key=repr)
