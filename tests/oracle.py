"""Compare registered Spark queries with their oracle SQL in DuckDB.

Usage: python tests/oracle.py [--sf DIR] [name ... | @module ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.sources.tables import TABLES  # noqa: E402


def connect(root: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _kind(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _cell(value, digits):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, digits) + 0.0) if digits else repr(value)
    return repr(value)


def _rows(columns, rows, digits):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i], digits) for i in order) for r in rows)


def compare(spark, con, entry, root):
    """(ok, message, seconds, rows) for one catalog entry."""
    started = time.time()
    frame = entry.job(spark, root)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.time() - started
    if entry.sql is None or con is None:
        return True, "rows only", seconds, len(got)
    cursor = con.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}", seconds, len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}", seconds, len(got)
    raw_a, raw_b = _rows(frame.columns, got, 0), _rows(names, want, 0)
    exact = raw_a == raw_b
    left, right = _rows(frame.columns, got, 6), _rows(names, want, 6)
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        return False, f"{len(diff)} rows differ, first {str(diff[0])[:1500]}", seconds, len(got)
    kinds_a = {c: {_kind(r[i]) for r in got[:500]} - {"null"} for i, c in enumerate(frame.columns)}
    kinds_b = {c: {_kind(r[i]) for r in want[:500]} - {"null"} for i, c in enumerate(names)}
    odd = {c: (kinds_a[c], kinds_b[c]) for c in kinds_a if kinds_a[c] != kinds_b[c]}
    note = "equal" if exact else "equal to 6 digits " + str([(a, b) for a, b in zip(raw_a, raw_b) if a != b][:2])
    return (not odd), note + (f" TYPES {odd}" if odd else ""), seconds, len(got)


def main(argv):
    from corpusflow.plans.registry import load_all
    from corpusflow.session import local_session

    root = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        root, argv = argv[1], argv[2:]
    catalog = load_all()
    names = [n for n in catalog if not argv or n in argv or f"@{catalog[n].home}" in argv]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = None if os.environ.get("NO_SQL") else connect(root)
    bad = 0
    for name in names:
        try:
            ok, note, seconds, rows = compare(spark, con, catalog[name], root)
        except Exception as error:  # report and go on with the next query
            ok, seconds, rows = False, 0.0, 0
            note = "ERROR " + str(error).split("JVM stacktrace")[0][:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {rows:7d} rows {seconds:6.2f}s  {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
