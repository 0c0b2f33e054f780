"""Run registered queries beside their comparison SQL: ``python tests/check_queries.py [pattern] [sf_dir]``."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.plans import load_all  # noqa: E402
from barloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, repr(v))
    if isinstance(v, (list, tuple)):
        return (2, repr([cell(x) for x in v]))
    return (3, f"{type(v).__name__}:{v!r}")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message, spark row count)"""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, "rows only", len(got)
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(n, a[1], b[1]) for n, a, b in zip(got_cols, *bad[0]) if a != b]
        return False, f"{len(bad)} rows differ, first: {diff} in {[x[1] for x in bad[0][0]][:6]}", len(got)
    return True, "equal", len(got)


if __name__ == "__main__":
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load_all()
    con, failed = duck(sf_dir), []
    for name, fn in queries.items():
        if not pattern.search(name):
            continue
        t0 = time.time()
        try:
            ok, msg, n = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, msg, n = False, f"{type(e).__name__}: {str(e)[:600]}", -1
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {n:7d} rows {time.time() - t0:6.2f}s  {msg}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
