"""Runs queries beside their DuckDB SQL: python tests/oracle.py [--dir DIR] [NAME...]; no names: all."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "None"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def views(d):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(d)):
        p = f"{d}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def differ(spark, name, d, query, sql):
    """What differs between a query and its SQL; None if nothing does and there are rows to compare. A query without SQL must only run."""
    df = query(spark, d)
    cols = sorted(df.columns)
    rows = sorted("|".join(plain(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.collect()))
    if sql is None:
        return None if df.columns else "no columns"
    got = views(d).execute(sql)
    names = [x[0] for x in got.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted("|".join(plain(r[i]) for i in at) for r in got.fetchall())
    if not rows and not want:
        return "no rows on either side: nothing was compared"
    if rows == want:
        return None
    only, miss = sorted(set(rows) - set(want)), sorted(set(want) - set(rows))
    return f"{len(rows)} rows against {len(want)}; only here {only[:3]}; missing {miss[:3]}"


def main(args):
    import __spark_entry__ as e

    from tracewell.runtime import session

    d = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        d, args = args[1], args[2:]
    spark = session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    q, s, bad = e.queries(), e.oracle_sql(), 0
    for name in args or q:
        began = time.time()
        try:
            why = differ(spark, name, d, q[name], s.get(name))
        except Exception as x:  # noqa: BLE001
            why = f"error {type(x).__name__}: {str(x)[:600]}"
        bad += why is not None
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - began:.1f}s {'' if name in s else '(no SQL)'} {why or ''}", flush=True)
    print("failed:", bad)
    os._exit(bad > 0)


if __name__ == "__main__":
    main(sys.argv[1:])
