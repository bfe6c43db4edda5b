"""Run registered queries on Spark and their SQL on DuckDB and compare.

Usage: python tests/oracle.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from riskframe.queries import load_all  # noqa: E402
from riskframe.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def local_session(cpus: str = "8"):
    return build_session("riskframe-tests", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder):
    """(ok, message, row count)."""
    df = query.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return True, "rows only", len(got)
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return (len(a) > 0), ("ok" if a else "EMPTY"), len(a)
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, (f"{len(a)} vs {len(b)} rows; {len(only_a)} differ {sorted(names)}\n"
                   f"   spark {only_a[:2]}\n   duck  {only_b[:2]}"), len(a)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    chosen = [q for n, q in registry.items() if not args.names or any(n.startswith(p) for p in args.names)]
    failed = []
    for q in chosen:
        start = time.time()
        try:
            ok, message, n = compare(spark, con, q, folder)
        except Exception as error:  # noqa: BLE001
            ok, message, n = False, f"{type(error).__name__}: {str(error)[:700]}", -1
        print(f"{'PASS' if ok else 'FAIL'} {q.name} [{q.covers}] rows={n} {time.time() - start:.2f}s "
              f"{'' if ok and message == 'ok' else message}", flush=True)
        if not ok:
            failed.append(q.name)
    print(f"{len(chosen) - len(failed)}/{len(chosen)} passed; failed: {failed}")
    spark.stop()
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
