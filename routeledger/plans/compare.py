"""Side-by-side check of a registered query against its DuckDB oracle.

Used by the tests and by ``python -m routeledger.plans.compare <sf_dir>``:
same column names, same row count, and the same multiset of rows after
sorting columns by name (money is compared as the exact doubles both
engines produce from DECIMAL sums).
"""

from __future__ import annotations

import math
import os
import sys
import time

EXACT = os.environ.get("ROUTELEDGER_EXACT") == "1"  # compare doubles bit for bit

RAW_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for v in RAW_VIEWS:
        p = f"{sf_dir.rstrip('/')}/{v}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {v} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare_one(spark, con, name: str, sf_dir: str) -> dict:
    from .catalog import REGISTRY, run
    e = REGISTRY[name]
    t0 = time.time()
    df = run(name, spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = df.columns
    t1 = time.time()
    res = {"name": name, "operator": e.operator, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if e.oracle is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(e.oracle)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={s_cols} oracle={d_cols}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a == b:
        res["status"] = "match"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"MISMATCH n={len(a)}/{len(b)} first={diff}"
    return res


def main(argv):
    from ..session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from .catalog import REGISTRY
    spark = build_session(shuffle_partitions=8)
    con = duck_connect(sf_dir)
    bad = 0
    for name in REGISTRY:
        if only and name not in only:
            continue
        try:
            r = compare_one(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("ok  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(REGISTRY)} registered, {bad} failing")


if __name__ == "__main__":
    main(sys.argv)
