"""Run registered queries against their SQL checks and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortwise.plans.views import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else v
    return str(v)


def _key(row):
    return tuple((x is not None, isinstance(x, str), x if x is not None else 0) for x in
                 (round(c, 3) if isinstance(c, float) else c for c in row))


def compare(cols_a, rows_a, cols_b, rows_b) -> str:
    """Empty string when equal, else what differs."""
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(cols_a)} vs {sorted(cols_b)}"
    order = sorted(cols_a)
    ia, ib = [cols_a.index(c) for c in order], [cols_b.index(c) for c in order]
    a = sorted((tuple(_cell(x[i]) for i in ia) for x in rows_a), key=_key)
    b = sorted((tuple(_cell(x[i]) for i in ib) for x in rows_b), key=_key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    off = [(x, y) for x, y in zip(a, b) if x != y]
    if not off:
        return ""
    close = all(len(x) == len(y) and all(
        p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6))
        for p, q in zip(x, y)) for x, y in off)
    return f"{'NEAR ' if close else ''}{len(off)}/{len(a)} rows differ, e.g. {dict(zip(order, off[0][0]))} vs {dict(zip(order, off[0][1]))}"


def check(spark, con, sf_dir, name, fn, sql) -> tuple[str, float, float, int]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    t1 = time.time()
    if sql is None:
        return ("" if rows else "no rows"), t1 - t0, 0.0, len(rows)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    oracle_rows = cur.fetchall()
    return compare(df.columns, rows, cols, oracle_rows), t1 - t0, time.time() - t1, len(rows)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from cohortwise.session import build_session

    sf_dir = argv[0]
    pick = argv[1:]
    spark = build_session(partitions=int(os.environ.get("CHECK_PARTITIONS", "8")))
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if pick and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in pick):
            continue
        try:
            msg, ts, td, n = check(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            msg, ts, td, n = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0, 0.0, 0
        bad += bool(msg)
        print(f"{'ok  ' if not msg else 'FAIL'} {name:40s} rows={n:7d} spark={ts:6.2f}s duck={td:6.2f}s {'' if name in oracles else '(rows only)'} {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
