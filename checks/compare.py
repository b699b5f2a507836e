"""Run queries against DuckDB: ``python -m checks.compare [folder] [name ...]``.

``PLAIN_SESSION=1`` uses a session without the library's settings.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from checks import QUERIES, SQL
from tableprep.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, folder, name):
    """Differences as text; empty when the results agree."""
    df = QUERIES[name](spark, folder)
    names, found = rows_of(df.columns, df.collect())
    if name not in SQL:
        return "" if found else "no rows"
    cursor = connection.execute(SQL[name])
    expected_names, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}"
    if not expected:
        return "both empty"
    wrong = [(a, b) for a, b in zip(found, expected) if repr(a) != repr(b)]
    return f"{len(wrong)} of {len(found)} rows differ, first: {str(wrong[0])[:600]}" if wrong else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    if os.environ.get("PLAIN_SESSION"):
        spark = SparkSession.builder.master("local[*]").getOrCreate()
    else:
        spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    connection, failed = oracle(folder), 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:800]
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree, {len(SQL)} of {len(QUERIES)} have SQL")
    return failed


if __name__ == "__main__":
    sys.exit(main())
