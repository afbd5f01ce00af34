"""Runs a query and its SQL over the same tables and compares their rows."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


def compare(spark, query, sql):
    frame = query(spark, str(DATA))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(frame.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.project(", ".join(f'"{c}"' for c in frame.columns)).fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in frame.collect()), key=repr) == want
