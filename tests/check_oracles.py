"""Runs queries and their SQL side by side: python tests/check_oracles.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace(" ", "T")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, sf_dir, f, sql, con):
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = con.sql(sql)
    names = rel.columns
    assert sorted(names) == cols, (cols, sorted(names))
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    got.sort(key=str)
    want.sort(key=str)
    return got == want, len(got), [x for x in zip(got, want) if x[0] != x[1]][:2] or (len(got), len(want))


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, q, o = duck(sf_dir), e.queries(), e.oracle_sql()
    for n in names or [x for x in q if not x.startswith(("op", "pipeline"))]:
        t = time.time()
        try:
            if n in o:
                same, rows, diff = compare(spark, sf_dir, q[n], o[n], con)
                print("ok  " if same else "DIFF", n, rows, f"{time.time() - t:.1f}s", "" if same else str(diff)[:600], flush=True)
            else:
                print("rows", n, q[n](spark, sf_dir).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print("FAIL", n, str(x)[:500].replace("\n", " "), flush=True)
