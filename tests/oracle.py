"""Run registered queries in Spark and DuckDB and compare.

python tests/oracle.py [--sf DIR] [--only a,b] [--module name]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v):
    return "bool" if isinstance(v, bool) else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    sn, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dn, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sn != dn:
        return f"columns {sn} != {dn}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    if not sr:
        return "no rows"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        diff = [(n, x, y) for n, x, y in zip(sn, *bad[0]) if x != y]
        return f"{len(bad)}/{len(sr)} rows differ, first: {diff} in {bad[0][0][:8]}"
    for name, x, y in zip(sn, sr[0], dr[0]):
        if x is not None and y is not None and _kind(x) != _kind(y):
            return f"type of {name}: {_kind(x)} != {_kind(y)}"
    return None


def main() -> int:
    from pixelweave.plans import registry
    from pixelweave.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    args = ap.parse_args()
    spark, con = local_session(), duck(args.sf)
    wanted = set(filter(None, args.only.split(",")))
    oracles, failed = registry.oracle_sql(), 0
    for name, fn in registry.queries().items():
        if wanted and name not in wanted:
            continue
        if args.module and args.module not in registry.MODULE_OF.get(name, ""):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else f"FAIL {problem}"
            else:
                state = f"rows {len(df.collect())} (no oracle)"
        except Exception as e:  # report and go on to the next query
            state = "ERROR " + " ".join(str(e).split())[:600]
        failed += state.startswith(("FAIL", "ERROR"))
        print(f"{name:34s} {time.time() - t0:6.2f}s  {state}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
