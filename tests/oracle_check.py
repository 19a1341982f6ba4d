"""Run catalogue queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of
rows (doubles rounded to 6 places).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm_value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_value(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    t2 = time.time()
    sc, sr = canon(s_cols, s_rows)
    dc, dr = canon(d_cols, d_rows)
    ok = sc == dc and sr == dr
    detail = ""
    if not ok:
        if sc != dc:
            detail = f"cols spark={sc} sql={dc}"
        elif len(sr) != len(dr):
            detail = f"rows spark={len(sr)} sql={len(dr)}"
        else:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            detail = f"first diffs {diff}"
    return ok, len(s_rows), len(d_rows), t1 - t0, t2 - t1, detail


def main():
    from lexigraph.plans.catalogue import ORACLE, QUERIES
    from lexigraph.session import get_spark

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    names = args or list(QUERIES)
    spark = get_spark(8, 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        fn = QUERIES[n]
        sql = ORACLE.get(n)
        if sql is None:
            t0 = time.time()
            cnt = fn(spark, sf_dir).count()
            print(f"ROWS-ONLY {n}: {cnt} rows {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            ok, ns, nd, ts, td, det = compare(spark, con, n, fn, sql, sf_dir)
        except Exception as e:  # report and continue
            ok, ns, nd, ts, td, det = False, -1, -1, 0, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {n}: spark={ns} sql={nd} ({ts:.1f}s/{td:.1f}s) {det}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
