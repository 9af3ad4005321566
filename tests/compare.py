"""Run queries on Spark and their SQL on DuckDB over the same files and compare the rows.

    python -m tests.compare SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.5f}" if value != int(value) else f"{int(value):d}"
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return f"{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, plan, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = plan(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL ({t1 - t0:.1f}s)"
    rel = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    t2 = time.time()
    times = f"({t1 - t0:.1f}s / {t2 - t1:.1f}s)"
    if got_cols != want_cols:
        return False, f"{name}: columns {got_cols} != {want_cols} {times}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{name}: {len(got)} rows vs {len(want)}; {diff} {times}"
    return True, f"{name}: {len(got)} rows equal {times}"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from labelscope.session import local_session

    sf_dir, prefixes = argv[0], tuple(argv[1:])
    spark, con, sql = local_session(), connect(sf_dir), oracle_sql()
    failed = 0
    for name, plan in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, message = compare(spark, con, name, plan, sql.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{name}: {type(e).__name__} {str(e)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", message, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
