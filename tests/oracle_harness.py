"""Run registered queries in Spark and their SQL twins in DuckDB, compare results.

Usage: python tests/oracle_harness.py [sf_dir] [key ...]
Comparison: same column names, same row count, same multiset of rows after
normalising values (floats to 9 significant digits, dates to ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if f != f:
            return (2, "nan")
        return (2, f"{f:.9g}")
    if isinstance(v, int):
        return (2, f"{float(v):.9g}") if abs(v) > 2**53 else (2, str(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return (3, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (4, repr([norm(x) for x in v]))
    if isinstance(v, dict):
        return (5, repr(sorted((k, norm(x)) for k, x in v.items())))
    return (6, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in (keys or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[k] = ("spark-error", repr(e)[:400])
            if verbose:
                print(f"{k:40s} SPARK ERROR {repr(e)[:400]}")
            continue
        ts = time.time() - t0
        if k not in sql:
            results[k] = ("no-oracle", len(s_rows))
            if verbose:
                print(f"{k:40s} rows={len(s_rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql[k])
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[k] = ("duck-error", repr(e)[:400])
            if verbose:
                print(f"{k:40s} DUCKDB ERROR {repr(e)[:400]}")
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_rows = len(s_rows) == len(d_rows)
        ok_vals = ok_cols and canon(s_cols, s_rows) == canon(d_cols, d_rows)
        status = "ok" if (ok_cols and ok_rows and ok_vals) else "MISMATCH"
        results[k] = (status, len(s_rows), len(d_rows))
        if verbose:
            print(f"{k:40s} {status:8s} spark={len(s_rows):7d} duck={len(d_rows):7d} {ts:.1f}s"
                  + ("" if ok_cols else f" cols {s_cols} vs {d_cols}"))
            if status != "ok" and ok_cols:
                a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
                sa, sb = set(a), set(b)
                print("   spark-only:", sorted(sa - sb)[:3])
                print("   duck-only: ", sorted(sb - sa)[:3])
    return results


if __name__ == "__main__":
    from salescope.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "no-oracle")]
    print("BAD:", bad)
