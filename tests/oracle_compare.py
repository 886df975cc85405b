"""Runs a registered query and its SQL over the same tables and compares rows as the driver does."""

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert glob.glob(f"{sf_dir}/*.parquet")
    return con


def compare(df, con, sql):
    """(rows of Spark, rows of SQL, rows only in one of them)."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(rel.columns) == names, (sorted(rel.columns), names)
    a = Counter(tuple(r[n] for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    b = Counter(tuple(r[k] for k in order) for r in rel.fetchall())
    return sum(a.values()), sum(b.values()), list((a - b).items())[:4], list((b - a).items())[:4]
