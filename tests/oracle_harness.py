"""Run registered queries next to their DuckDB oracle and compare results.

Usage: python tests/oracle_harness.py [sf_dir] [key ...]
Compares row count, sorted column names and the multiset of rows (values
normalised: floats to 9 significant digits, NaN/None as NULL).
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.9g}"
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def compare(spark, con, key, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    st = time.time() - t
    scols = sdf.columns
    if sql is None:
        return {"key": key, "ok": None, "rows": len(srows), "spark_s": round(st, 2)}
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    res = {"key": key, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(st, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"columns {sorted(scols)} != {sorted(dcols)}")
        return res
    a = rows_of(scols, [tuple(r) for r in srows])
    b = rows_of(dcols, drows)
    if a != b:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        res.update(ok=False, why=f"values differ: spark-only {diff} oracle-only {diff2}")
        return res
    res.update(ok=True)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    from catchment.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, con, k, qs[k], os_.get(k), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
