"""Compare bound queries with DuckDB on the same parquet tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value if value is None or isinstance(value, (int, str)) else str(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(cells, key=repr)


def differences(spark, folder: str, name: str, queries, oracles) -> tuple[list[str], int, float]:
    """Text of what differs (empty when all rows agree), the row count and the seconds Spark took."""
    start = time.time()
    df = queries[name](spark, folder)
    got = [tuple(row) for row in df.collect()]
    spent = time.time() - start
    if name not in oracles:
        return [], len(got), spent
    result = connect(folder).execute(oracles[name])
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    problems = []
    got_columns, got_rows = _sorted(df.columns, got)
    want_columns, want_rows = _sorted(columns, want)
    if got_columns != want_columns:
        problems.append(f"columns {got_columns} != {want_columns}")
    spark_names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                   "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    for column, kind in df.dtypes:
        if kinds.get(column) != spark_names.get(kind, kind):
            problems.append(f"type of {column}: {kind} != {kinds.get(column)}")
    if len(got_rows) != len(want_rows):
        problems.append(f"{len(got_rows)} rows != {len(want_rows)}")
    if got_rows != want_rows:
        only_got, only_want = set(got_rows) - set(want_rows), set(want_rows) - set(got_rows)
        problems.append(f"{len(only_got)} extra, e.g. {sorted(only_got, key=repr)[:2]}; {len(only_want)} missing, e.g. {sorted(only_want, key=repr)[:2]}")
    return problems, len(got), spent


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from scholium.session import local_session

    folder = argv[0]
    spark = local_session("oracle")
    bound, oracles = queries(), oracle_sql()
    names = argv[1:] or list(bound)
    failed = 0
    for name in names:
        try:
            problems, rows, spent = differences(spark, folder, name, bound, oracles)
        except Exception as error:  # report and go on with the next query
            problems, rows, spent = [f"{type(error).__name__}: {str(error)[:600]}"], 0, 0.0
        failed += bool(problems)
        mark = "FAIL" if problems else "ok" if name in oracles else "rows"
        print(f"{mark:5}{name:28}{rows:8} rows {spent:7.2f} s  {' | '.join(problems)[:900]}", flush=True)
    print(f"{failed} of {len(names)} differ")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
