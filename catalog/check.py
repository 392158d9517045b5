"""Run queries next to their SQL and compare the rows.

    python -m catalog.check [name ...] [--sf /path/to/sf0.01]
"""

from __future__ import annotations

import argparse
import math
import os
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(list(v)) if isinstance(v, (list, tuple)) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def main() -> int:
    from catalog.queries import QUERIES, SQL

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    names = [n for n in QUERIES if not args.names or any(a in n for a in args.names)]
    spark, con = make_session(os.environ.get("BENCH_CPUS", "8")), duck(args.sf)
    bad = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got, columns = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - start
        if name not in SQL:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            r = con.execute(SQL[name])
            want, want_columns = rows_of([d[0] for d in r.description], r.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"SQL?  {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        if columns != want_columns:
            print(f"COLS  {name}: {columns} != {want_columns}", flush=True)
            bad.append(name)
        elif got != want:
            only = [x for x in got if x not in set(want)][:4]
            miss = [x for x in want if x not in set(got)][:4]
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows\n  {columns}", flush=True)
            for x in only:
                print("   spark", x)
            for x in miss:
                print("   sql  ", x)
            bad.append(name)
        else:
            print(f"ok    {name}: {len(got)} rows {took:.1f}s", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not: {bad}")
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main())
