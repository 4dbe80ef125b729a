"""Run queries and their SQL side by side: ``python -m workloads.compare [sf] [query ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def compare(spark, con, folder: str, query, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, folder)
    kinds = dict(df.dtypes)
    mine = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if mine else "no rows"
    cursor = con.execute(sql)
    theirs_kinds = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    names = sorted(kinds)
    if names != sorted(theirs_kinds):
        return f"columns {names} against {sorted(theirs_kinds)}"
    wrong = {n: (kinds[n], theirs_kinds[n]) for n in names if TYPES.get(kinds[n]) != theirs_kinds[n]}
    if wrong:
        return f"types {wrong}"
    order_a, order_b = [list(kinds).index(n) for n in names], [list(theirs_kinds).index(n) for n in names]
    a = sorted(tuple(repr(r[i]) for i in order_a) for r in mine)
    b = sorted(tuple(repr(r[i]) for i in order_b) for r in theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first {names}: {bad[0]}"
    return "" if a else "no rows"


def main() -> None:
    from synthtab.session import local_session, staging
    from workloads.oracles import ORACLES
    from workloads.queries import QUERIES

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(folder)
    for name in names:
        start = time.time()
        try:
            with staging(spark):
                found = compare(spark, con, folder, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        note = "" if name in ORACLES else " (rows only)"
        print(f"{'ok  ' if not found else 'FAIL'} {name}{note} {time.time() - start:.1f}s {found}", flush=True)


if __name__ == "__main__":
    main()
