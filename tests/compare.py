"""Run registered queries next to their oracle SQL and compare the results.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from reachgrid.catalog import load
from reachgrid.catalog.bindings import TABLES
from reachgrid.session import build_session

DATA = "/root/testdata"


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool) or not hasattr(value, "__float__"):
        return str(value)
    number = float(value)
    return "nan" if math.isnan(number) else number


def table_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def same(a, b, tolerance=0.0):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance) for x, y in zip(a, b))


def compare(spark: SparkSession, con, name: str, folder: str, tolerance: float = 0.0) -> str | None:
    """None when equal, else what differs."""
    queries, sqls = load()
    df = queries[name](spark, folder)
    got = table_of([tuple(r) for r in df.collect()], df.columns)
    if name not in sqls:
        return None if got else "no rows"
    cur = con.execute(sqls[name])
    names = [d[0] for d in cur.description]
    want = table_of(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if not same(g, w, tolerance)]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]} columns {sorted(names)}"
    return None if got else "no rows on either side"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"{DATA}/sf{args.sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    failed = 0
    for name in args.names or load()[0]:
        begun = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
