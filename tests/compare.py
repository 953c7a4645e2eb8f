"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

``python tests/compare.py [sf] [query ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, item, sf_dir: str) -> str | None:
    """None when equal, else the first difference."""
    df = item.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if item.sql is None:
        return None if got else "no rows"
    cur = con.execute(item.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "both empty"
    for g, w in zip(got, want):
        if g != w:
            return f"\n  spark {str(g)[:600]}\n  duck  {str(w)[:600]}"
    return None


if __name__ == "__main__":
    from rungwork.plans.catalog import REGISTRY
    from rungwork.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    path = f"/root/testdata/sf{sf}"
    spark, con = build_session(int(os.environ.get("CPUS", "8"))), duck(path)
    chosen = sys.argv[2:] or list(REGISTRY)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, con, REGISTRY[name], path)
        except Exception as exc:  # report and go on to the next query
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} equal")
