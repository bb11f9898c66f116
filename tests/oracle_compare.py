"""Run registered queries in Spark and their SQL in DuckDB, and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and the multiset of rows (columns sorted by
name). Floats are compared exactly and, as a diagnostic, at 9 decimals.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vitae.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    return v


def rows_of(records, cols, digits):
    return Counter(tuple(_norm(r[c], digits) for c in cols) for r in records)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    scols = sorted(sdf.columns)
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-sql"
        return res
    cur = con.execute(sql)
    dcols_raw = [d[0] for d in cur.description]
    drows = [dict(zip(dcols_raw, r)) for r in cur.fetchall()]
    res["duck_s"] = round(time.time() - t1, 2)
    res["duck_rows"] = len(drows)
    dcols = sorted(dcols_raw)
    if scols != dcols:
        res["status"] = f"COLUMNS {scols} vs {dcols}"
        return res
    exact = rows_of(srows, scols, None) == rows_of(drows, dcols, None)
    a, b = rows_of(srows, scols, 9), rows_of(drows, dcols, 9)
    approx = a == b
    res["status"] = "OK" if exact else ("APPROX" if approx else "MISMATCH")
    if not approx:
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        res["only_spark"] = only_s
        res["only_duck"] = only_d
        res["n_diff"] = sum((a - b).values())
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from vitae.session import get_spark
    spark = get_spark()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("OK", "no-sql"):
            bad += 1
        print(r, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
