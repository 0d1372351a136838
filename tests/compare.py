"""Runs registered queries next to their cross-check SQL: python tests/compare.py <sf_dir> [name prefix ...]"""
from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cores}]").appName("foresift")
            .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())


def oracle(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(got: list[tuple], want: list[tuple], tol: float = 0.0) -> list[str]:
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    out = []
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and (
                abs(x - y) <= tol or (math.isnan(x) and math.isnan(y))))
            if not same:
                out.append(f"{a} != {b}")
                break
    return out


def check(spark, con, name, sf_dir, tol: float = 0.0):
    import __spark_entry__ as entry
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return took, len(got), None, got[:3]
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return took, len(got), [f"columns {cols} != {sorted(names)}"], None
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    return took, len(got), differences(got, want, tol), time.time() - t0


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = sys.argv[1]
    spark, con = session(), oracle(sf)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in entry.queries() if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for n in names:
        try:
            took, rows, diff, extra = check(spark, con, n, sf)
        except Exception as e:      # report and go on with the next query
            bad += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
            continue
        status = "rows" if diff is None else ("ok" if not diff else "DIFF")
        bad += status == "DIFF"
        print(f"{status:5} {n:28} {took:6.2f}s {rows:7} rows  {extra if not diff else diff[:2]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
