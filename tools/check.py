"""Compare registered queries with their SQL in DuckDB: python tools/check.py [names…]."""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(value):
    if value is None:
        return "\x00null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value if value != 0 else 0.0)
    return f"{type(value).__name__}:{value}"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main() -> int:
    from hindcast.catalog import load
    from hindcast.session import local_session

    queries, oracle = load()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = [a for a in sys.argv[1:]] or list(queries)
    names = [n for n in queries if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names:
        guard = threading.Timer(float(os.environ.get("LIMIT", "60")), spark.sparkContext.cancelAllJobs)
        guard.start()
        try:
            t0 = time.time()
            df = queries[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time() - t0
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {str(exc)[:700]}", flush=True)
            continue
        finally:
            guard.cancel()
        if name not in oracle:
            print(f"rows {name}: {len(rows)} rows, spark {t1:.1f}s (no SQL)")
            continue
        try:
            t0 = time.time()
            cur = con.execute(oracle[name])
            cols = [d[0] for d in cur.description]
            exp = cur.fetchall()
            t2 = time.time() - t0
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"SQL  {name}: {str(exc)[:1500]}")
            continue
        a, b = canon(df.columns, rows), canon(cols, exp)
        same = sorted(df.columns) == sorted(cols) and a == b
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(rows)} vs {len(exp)} rows, spark {t1:.1f}s duckdb {t2:.1f}s", flush=True)
        if not same:
            bad += 1
            print("   cols", sorted(df.columns), sorted(cols))
            sa, sb = set(a), set(b)
            for r in sorted(sa - sb)[:3]:
                print("   spark only", r)
            for r in sorted(sb - sa)[:3]:
                print("   sql only  ", r)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
