"""Runs catalogue queries in Spark and their SQL twins in DuckDB and compares the results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, path, name, fn, sql):
    """Empty string on a match, else the first difference."""
    df = fn(spark, path)
    sn, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ""
    cur = con.execute(sql)
    dn, dr = rows_of([c[0] for c in cur.description], cur.fetchall())
    if sn != dn:
        return f"columns {sn} != {dn}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}; spark {sr[:2]} duck {dr[:2]}"
    if sr == dr:
        if {type(x) for r in sr for x in r} != {type(x) for r in dr for x in r}:
            return f"types differ: {sr[:1]} {dr[:1]}"
        return ""
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)}/{len(sr)} rows differ; columns {sn}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"


if __name__ == "__main__":
    from loanforge.plans.catalog import all_queries, all_sql
    from loanforge.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(8)
    con = connect(sf)
    sql = all_sql()
    bad = 0
    for name, fn in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            msg = compare(spark, con, sf, name, fn, sql.get(name))
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.2f}s {'' if sql.get(name) else '(rows only)'} {msg}", flush=True)
    print("failures:", bad)
