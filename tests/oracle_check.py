"""Run registered queries and their SQL side by side: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Returns (ok, message)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"rows-only n={len(got)} {took:.2f}s"
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    msg = f"n={len(got)} {took:.2f}s"
    if sorted(df.columns) != sorted(want_cols):
        return False, f"{msg} columns {sorted(df.columns)} != {sorted(want_cols)}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    spark_types = {c: names.get(t, t) for c, t in df.dtypes}
    odd = [(c, spark_types[c], t) for c, t in zip(want_cols, want_types) if spark_types[c] != t.upper()]
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{msg} rows {len(a)} vs {len(b)}\n   spark only: {str(only_a)[:1500]}\n   sql only:   {str(only_b)[:1500]}"
    if odd:
        return False, f"{msg} types differ {odd}"
    if not got:
        return False, f"{msg} EMPTY"
    return True, msg


def main() -> int:
    import __spark_entry__ as entry_module
    from millrace.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if args and args[0][0].isdigit():
        sf = args.pop(0)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(cores=8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    names = [n for n in queries if not args or any(a in n for a in args)]
    bad = []
    for name in names:
        try:
            ok, msg = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as ex:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:1500]}"
        print(("ok   " if ok else "FAIL ") + name + " " + msg, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
