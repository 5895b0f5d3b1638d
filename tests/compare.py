"""Registered queries against their SQL in DuckDB: same columns, same rows.

Run as a script: python tests/compare.py [sf_dir] [name ...]
"""

import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in rows)


def difference(spark, db, sf, query, sql):
    """None when equal, else a short description."""
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, lost = list((got - want).elements()), list((want - got).elements())
        return f"{sum(got.values())} rows, want {sum(want.values())}; extra {str(extra[:2])[:600]} lost {str(lost[:2])[:600]}"
    return None


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    bad = 0
    for name in names:
        started = time.time()
        try:
            why = difference(spark, db, sf, queries()[name], oracle_sql()[name])
        except Exception as e:  # report and go on
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        print(f"{name:32s} {time.time() - started:6.1f}s {'ok' if why is None else why}", flush=True)
    print("all equal" if not bad else f"{bad} differ")
