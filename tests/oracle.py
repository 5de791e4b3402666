"""Runs a query and its SQL on one of the given scale folders and compares the rows."""

import os

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False))


def both(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return rows(query(spark, FOLDER).toPandas()), rows(db.sql(sql).df())
