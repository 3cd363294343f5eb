"""Compares queries with their SQL in DuckDB: rows, columns, values (floats to 9 digits)."""
from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def database(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "shape", None) == ():
            return f"{float(v) + 0.0:.9g}"
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
            return "[" + ",".join(one(x) for x in (v.tolist() if hasattr(v, "tolist") else v)) + "]"
        return str(v)

    return sorted(map(tuple, (map(one, row) for row in df.astype(object).itertuples(index=False))))


def compare(spark, con, name: str, query, sql: str, d: str) -> str:
    """An empty string, or what differs."""
    got = query(spark, d).toPandas()
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        from collections import Counter

        x, y = Counter(a) - Counter(b), Counter(b) - Counter(a)
        return f"{name}: {len(a)} and {len(b)} rows, {sum(x.values())} differ: {list(x)[:2]} and {list(y)[:2]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    d, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    con, sqls, queries = database(d), e.oracle_sql(), e.queries()
    for n in names or queries:
        at = time.time()
        try:
            if n in sqls:
                said = compare(spark, con, n, queries[n], sqls[n], d) or "ok"
            else:
                said = f"no SQL, {queries[n](spark, d).count()} rows"
        except Exception as x:
            said = f"ERROR {type(x).__name__} {str(x)[:600]}"
        print(f"{n} [{time.time() - at:.1f} s] {said}", flush=True)
