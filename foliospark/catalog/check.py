"""Compare registered queries with their oracle text in DuckDB.

    python -m foliospark.catalog.check [SF_DIR] [NAME ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

from foliospark.catalog import load
from foliospark.catalog.tables import BASE, Tables, oracle


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, con) -> tuple[str, str, float]:
    start = time.time()
    df = query.run(Tables(spark, sf_dir))
    got = df.collect()
    took = time.time() - start
    if query.sql is None:
        return "rows-only", f"{len(got)} rows", took
    result = con.execute(oracle(query.sql))
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", f"{sorted(df.columns)} != {sorted(names)}", took
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if left == right:
        return "ok", f"{len(got)} rows", took
    extra = [r for r in left if r not in set(right)][:2]
    miss = [r for r in right if r not in set(left)][:2]
    return "DIFF", f"{len(left)} vs {len(right)} rows; extra {str(extra)[:400]}; missing {str(miss)[:400]}", took


def main() -> None:
    import duckdb

    from foliospark.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    registry = load()
    names = [n for n in registry if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session("check", 8)
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    bad = 0
    for name in names:
        try:
            state, note, took = compare(spark, sf_dir, registry[name], con)
        except Exception as exc:  # one failing query must not hide the others
            state, note, took = "ERROR", str(exc).strip().replace("\n", " ")[:600], 0.0
        if state not in ("ok", "rows-only"):
            bad += 1
        print(f"{state:9} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
