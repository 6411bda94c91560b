"""Run registered Spark queries next to their DuckDB oracle and compare.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quaymind.session import get_session  # noqa: E402
from quaymind.sources.fixtures import BASE_TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, q, sf_dir, verbose=True):
    t0 = time.time()
    sdf = q.run(spark, sf_dir)
    srows = [tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect()]
    ts = time.time() - t0
    if not q.oracle:
        print(f"{name:32s} rows={len(srows):7d} spark={ts:6.2f}s  (no oracle)")
        return True
    t0 = time.time()
    res = con.execute(q.oracle)
    cols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    td = time.time() - t0
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    drows = [tuple(_norm(r[i]) for i in order) for r in drows_raw]
    ok_cols = sorted(cols) == sorted(sdf.columns)
    key = lambda r: tuple(str(x) for x in r)
    ok = ok_cols and sorted(srows, key=key) == sorted(drows, key=key)
    print(f"{name:32s} rows={len(srows):7d}/{len(drows):7d} spark={ts:6.2f}s duck={td:6.2f}s "
          f"{'OK' if ok else 'MISMATCH'}")
    if not ok and verbose:
        if not ok_cols:
            print("   spark cols", sorted(sdf.columns), "\n   duck cols ", sorted(cols))
        else:
            ss, ds = set(srows), set(drows)
            print("   only spark:", sorted(ss - ds, key=key)[:3])
            print("   only duck: ", sorted(ds - ss, key=key)[:3])
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from quaymind.plans.registry import load_all
    spark = get_session()
    con = duck(sf_dir)
    bad = []
    for name, q in load_all().items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            if not compare(spark, con, name, q, sf_dir):
                bad.append(name)
        except Exception as e:  # report and continue
            print(f"{name:32s} ERROR {type(e).__name__}: {str(e)[:400]}")
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
