"""Run registered queries against their SQL twins in DuckDB and compare whole results.

Usage: python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT",
}


def compare(df, con, sql):
    """Return None when equal, else a short description of the difference."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name, dtype in df.dtypes:
        if TYPES.get(dtype, dtype) != types[name]:
            return f"type of {name}: {dtype} != {types[name]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {[r for r in got if r not in set(want)][:2]} / {[r for r in want if r not in set(got)][:2]}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return f"{len(diff)} rows differ, e.g. {diff[0]}"
    return None if got else "EMPTY RESULT"


def main():
    from marginalia.plans import catalog
    from marginalia.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("oracle-check")
    con = connect(args.sf)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = df.count()
                problem = None if n else "EMPTY RESULT"
                print(f"     rows only: {n}")
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
