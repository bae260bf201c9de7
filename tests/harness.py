"""Spark-vs-DuckDB comparison in the spirit of the driver's correctness gate.

Row count, column names, and an order-insensitive comparison of normalised values.
Run all: ``python -m tests.harness [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())


def compare(spark, con, name, sf_dir):
    from faultlens.plans.catalog import ORACLES, QUERIES
    t0 = time.time()
    scols, srows = rows_of_spark(QUERIES[name](spark, sf_dir))
    t1 = time.time()
    if name not in ORACLES:
        return {"name": name, "status": "rows-only", "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    dcols, drows = rows_of_duck(con, ORACLES[name])
    status = "ok"
    detail = ""
    if scols != dcols:
        status, detail = "schema", f"spark={scols} duck={dcols}"
    elif len(srows) != len(drows):
        status, detail = "rowcount", f"spark={len(srows)} duck={len(drows)}"
    elif srows != drows:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        status, detail = "values", str(diff)
    return {"name": name, "status": status, "rows": len(srows), "spark_s": round(t1 - t0, 2),
            "detail": detail[:600]}


def main(argv):
    from faultlens.plans.catalog import QUERIES, load_all
    from faultlens.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    load_all()
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(QUERIES)):
        try:
            res = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and continue
            res = {"name": name, "status": "error", "detail": repr(exc)[:600]}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
