"""Run the driver queries and their SQL checks side by side and compare the rows.

    python tools/compare.py <folder> [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lorecairn.plans import CHECKS, QUERIES  # noqa: E402
from lorecairn.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def normal(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def difference(spark, db, name: str, folder: str) -> tuple[str, int]:
    """Empty text when the query equals its check, and the number of rows."""
    result = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in result.collect()]
    if name not in CHECKS:
        return "", len(rows)
    cursor = db.execute(CHECKS[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(columns)}", len(rows)
    ours, theirs = normal(result.columns, rows), normal(columns, expected)
    if ours == theirs:
        return "", len(rows)
    only_ours = [r for r in ours if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} rows != {len(theirs)}; ours {only_ours} sql {only_theirs}", len(rows)


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or sorted(QUERIES)
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, rows = difference(spark, db, name, folder)
        except Exception as error:  # reported like any other difference
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += bool(problem)
        state = "DIFF " + problem[:1200] if problem else "ok" if name in CHECKS else "rows only"
        print(f"{name:28s} {rows:7d} {time.time() - start:7.1f}s {state}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main())
