"""Compare every query with its SQL: column names and types, row count, and rows in any order.

``python -m tests.oracle [sf] [name ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.10g}"
    return value


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences found; none when both sides agree."""
    mine = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    names = sorted(mine.column_names)
    if names != sorted(theirs.column_names):
        return [f"columns {names} against {sorted(theirs.column_names)}"]
    problems = []
    for name in names:
        left, right = mine.schema.field(name).type, theirs.schema.field(name).type
        if left != right:
            problems.append(f"type of {name}: {left} against {right}")
    if mine.num_rows != theirs.num_rows:
        problems.append(f"rows: {mine.num_rows} against {theirs.num_rows}")
    if not mine.num_rows:
        problems.append("no rows")
    left, right = (
        Counter(zip(*[[_plain(v) for v in t.column(n).to_pylist()] for n in names])) for t in (mine, theirs)
    )
    if left != right:
        problems.append(f"only here {list((left - right).items())[:3]}; only there {list((right - left).items())[:3]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from wardenry.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session(8), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.count() else ["no rows"])
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
