"""Run queries and their SQL side by side: python tests/check_queries.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    return float(f"{value:.12g}") if isinstance(value, float) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(plain(row[i])) for i in order) for row in rows)


def compare(spark, db, folder: str, name: str) -> list[str]:
    """What differs; nothing if the results agree."""
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        return []
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if got != want:
        extra, lacking = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        problems.append(f"{len(got)} rows, want {len(want)}; only here {extra[:2]}; only there {lacking[:2]}")
    return problems


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        started = time.time()
        try:
            problems = compare(spark, db, folder, name)
        except Exception as problem:  # noqa: BLE001
            problems = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s", *(p[:900] for p in problems), sep="\n     " if problems else " ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
