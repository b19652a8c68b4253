"""Run queries beside their SQL counterparts: ``python tests/check.py 0.01 [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(df, con, sql):
    """None when both results hold the same rows, otherwise what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} vs {sorted(rel.columns)}"
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    order = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        parts = [(n, x, y) for n, x, y in zip(names, *bad[0]) if x != y]
        return f"{len(bad)} rows differ, first: {parts}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"{TESTDATA}/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sql:
                found = difference(query(spark, sf_dir), con, sql[name])
            else:
                found = f"no SQL, {query(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            found = f"ERROR {str(e)[:600]}"
        failed += found is not None and name in sql
        print(f"{name:32s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
