"""Compare each query with its SQL in DuckDB: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "is_finite"):
        return float(value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(r[i]) for i in order) for r in rows]
    table.sort(key=lambda t: tuple((v is None, str(type(v)), "" if v is None else str(v)) for v in t))
    return sorted(columns), table


def difference(spark, con, sf_dir, query, sql) -> str:
    """Empty when both give the same columns and the same multiset of rows."""
    df = query(spark, sf_dir)
    mine_columns, mine = normalised(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs_columns, theirs = normalised([d[0] for d in result.description], result.fetchall())
    if mine_columns != theirs_columns:
        return f"columns {mine_columns} != {theirs_columns}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0]} of {mine_columns}" if wrong else ""


def main() -> int:
    from capital_access.session import build_session
    from capital_access.queries import catalogue

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("8", **{"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='run-')}"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in args or catalogue.QUERIES:
        start = time.time()
        try:
            if name in catalogue.ORACLES:
                found = difference(spark, con, sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name])
            else:
                found = f"rows only: {catalogue.QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # keep going, report all
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad = bool(found) and not found.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:28s} {time.time() - start:6.2f}s {found}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
