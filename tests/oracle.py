"""Compare registered queries with DuckDB.  `python tests/oracle.py SF [name-prefix ...]`."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list):
        return str(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(norm(x[i]) for i in order) for x in data]


def compare(spark, con, name, q, sf_dir):
    from barloom.plans.registry import Views

    t0 = time.time()
    df = q.build(Views(spark, sf_dir))
    got_c, got = rows(df.columns, df.collect())
    print(f"[{time.time() - t0:5.1f}s]", end=" ")
    if q.sql is None:
        return f"rows-only {len(got)}"
    cur = con.execute(q.sql)
    exp_c, exp = rows([d[0] for d in cur.description], cur.fetchall())
    if got_c != exp_c:
        return f"COLUMNS {got_c} != {exp_c}"
    key = lambda t: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in t)
    got, exp = sorted(got, key=key), sorted(exp, key=key)
    if len(got) != len(exp):
        return f"ROWS spark {len(got)} sql {len(exp)}"
    bad = [(a, b) for a, b in zip(got, exp) if a != b]
    if bad:
        return f"VALUES {len(bad)} of {len(got)} differ; {got_c}; spark {bad[0][0]} sql {bad[0][1]}"
    if not got:
        return "ok EMPTY"
    empty = [c for j, c in enumerate(got_c) if all(t[j] is None for t in got)]
    return f"ok {len(got)}" + (f" all-null {empty}" if empty else "")


def main() -> int:
    from barloom.plans import load
    from barloom.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    fails = 0
    for name, q in load().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            res = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e).strip()[:700]
            if "--trace" in sys.argv:
                traceback.print_exc()
        spark.catalog.clearCache()
        fails += not res.startswith(("ok", "rows"))
        print(f"{name:34s} {time.time() - t:6.2f}s {res}", flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    raise SystemExit(main())
