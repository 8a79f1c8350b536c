"""Run registered queries in Spark and their oracle SQL in DuckDB; report row/schema/value matches.

    python tools/oracle_check.py [--sf-dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from riskloom.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", repr(v))
    if v is None:
        return ("null",)
    return ("v", str(v))


def rows_of(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def compare(spark, con, name, build, sql, sf_dir):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_rows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = [dict(zip(d_cols, r)) for r in res.fetchall()]
    t2 = time.time()
    s_cols = sdf.columns
    out = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"COLUMNS differ: spark={s_cols} duck={d_cols}"
        return out
    cols = sorted(s_cols)
    a, b = rows_of(s_rows, cols), rows_of(d_rows, cols)
    if a == b:
        out["status"] = "MATCH"
    else:
        sa, sb = set(a), set(b)
        out["status"] = "VALUES differ"
        out["only_spark"] = [dict(zip(cols, r)) for r in list(sa - sb)[:3]]
        out["only_duck"] = [dict(zip(cols, r)) for r in list(sb - sa)[:3]]
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from riskloom.plans.registry import REGISTRY
    from riskloom.session import get_spark

    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf_dir)
    bad = 0
    for name, e in REGISTRY.items():
        if args.names and name not in args.names:
            continue
        if e.sql is None:
            n = e.build(spark, args.sf_dir).count()
            print(f"{name:32s} rows-only {n}")
            continue
        r = compare(spark, con, name, e.build, e.sql, args.sf_dir)
        flag = r.pop("status")
        print(f"{name:32s} {flag:14s} {r}")
        bad += flag != "MATCH"
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
