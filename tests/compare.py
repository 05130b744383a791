"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import os
import time

import duckdb

from frostline.workload.registry import TABLES

DATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return (type(v).__name__, repr(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr
    )


# Spark type and the DuckDB type a driver would see as the same.
SAME = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def compare(spark, con, sf_dir, fn, sql):
    """None when both agree, else what differs."""
    started = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    for name, kind in df.dtypes:
        if name in types and SAME.get(kind, types[name]) != types[name]:
            return f"type of {name}: {kind} / {types[name]}", took, len(got)
    g, w = rows_of(df.columns, got), rows_of(names, want)
    if g[0] != w[0]:
        return f"columns {g[0]} / {w[0]}", took, len(got)
    if g[1] != w[1]:
        only_g = [r for r in g[1] if r not in set(w[1])][:3]
        only_w = [r for r in w[1] if r not in set(g[1])][:3]
        return f"rows {len(g[1])} / {len(w[1])}: {only_g} / {only_w}", took, len(got)
    return None, took, len(got)


def main(names=None, sf="sf0.01"):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from frostline.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/{sf}"
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            if name in oracle:
                problem, took, rows = compare(spark, con, sf_dir, fn, oracle[name])
                note = problem or "same"
            else:
                started = time.time()
                rows = len(fn(spark, sf_dir).collect())
                took, problem, note = time.time() - started, None, "rows only"
        except Exception as e:
            problem, took, rows, note = str(e), 0, -1, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {rows:7d} rows {took:6.2f}s  {note}",
              flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main(sys.argv[1:])
