"""Run catalogue queries in Spark and their SQL in DuckDB, and compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]

Compares row count, column names and the sorted rows exactly (floats to the
last bit, arrays element by element), the way the external check does.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def key(row):
    return tuple(repr(x) for x in row)


def compare(spark, con, name, qfn, sql, sf_dir, show=5):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    srows = [tuple(norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    drows = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    t2 = time.time()
    ok_cols = sorted(sdf.columns) == sorted(cols)
    srows.sort(key=key)
    drows.sort(key=key)
    ok_n = len(srows) == len(drows)
    diffs = [(a, b) for a, b in zip(srows, drows) if a != b]
    ok = ok_cols and ok_n and not diffs
    print(f"{'OK ' if ok else 'BAD'} {name}: spark {len(srows)} rows {t1 - t0:.1f}s, "
          f"duckdb {len(drows)} rows {t2 - t1:.1f}s"
          + ("" if ok_cols else f" cols {sorted(sdf.columns)} vs {sorted(cols)}")
          + (f" diffs {len(diffs)}" if diffs else ""), flush=True)
    for a, b in diffs[:show]:
        print("   spark:", str(a)[:300])
        print("   duck :", str(b)[:300])
    return ok


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    from wordloom.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    keys = keys or [k for k in qs if k in sqls]
    bad = []
    for k in keys:
        try:
            if not compare(spark, con, k, qs[k], sqls[k], sf_dir):
                bad.append(k)
        except Exception as e:  # report and continue
            print(f"ERR {k}: {type(e).__name__}: {str(e)[:500]}", flush=True)
            bad.append(k)
    print("missing oracle:", [k for k in qs if k not in sqls])
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
