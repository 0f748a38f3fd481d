"""Comparing a query with its SQL, as sets of rows with columns by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=str)


def assert_same(spark, sf_dir, query, sql):
    got = rows(query(spark, sf_dir).toPandas())
    want = rows(connect(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
