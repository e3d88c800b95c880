"""Run named queries in Spark and their check text in DuckDB, and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

from cohortspark.plans.catalog import catalog
from cohortspark.sources.derived import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (decimal.Decimal, int, float)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f"{f:.9g}" if f != 0 else "0"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str):
    """``(ok, message)`` for one query."""
    q = catalog()[name]
    start = time.time()
    df = q.run(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if q.sql is None:
        return len(got) > 0, f"rows only: {len(got)} in {took:.2f}s"
    rel = con.sql(q.sql)
    want_cols, want = _rows(rel.columns, rel.fetchall())
    have_cols, have = _rows(df.columns, got)
    if have_cols != want_cols:
        return False, f"columns {have_cols} != {want_cols}"
    if len(have) != len(want):
        return False, f"rows {len(have)} != {len(want)}; e.g. {list(set(have) ^ set(want))[:3]}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if bad:
        return False, f"{len(bad)} of {len(want)} rows differ in {have_cols}, e.g.\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    return True, f"{len(want)} rows in {took:.2f}s"


def main():
    from cohortspark.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]")
    con = connect(sf_dir)
    bad = []
    for name in catalog():
        if only and not any(o in (name, catalog()[name].run.__module__.rsplit(".", 1)[-1]) for o in only):
            continue
        try:
            ok, message = compare(spark, con, sf_dir, name)
        except Exception as exc:  # show every failure, keep going
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        if not ok:
            bad.append(name)
        print(("ok   " if ok else "FAIL ") + name + ": " + message, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
