"""Runs registered queries and compares each with its SQL in DuckDB.

    python tests/check.py [SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted, types kept apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when columns, types of values, and values are equal."""
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = rows_of(want_columns, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(want_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            same = type(a) is type(b) and (a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b)))
            if not same:
                return f"{g} != {w}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from lakejobs.session import build_session

    spark = build_session(
        "check", "local[8]", spark__ui__enabled=False, spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__showConsoleProgress=False,
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                note = f"rows only: {df.limit(3).collect()}"
            else:
                note = differences(df, con, sql) or "same"
                failed += note != "same"
        except Exception as error:  # noqa: BLE001
            failed += 1
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:26} {time.time() - start:6.2f}s  {note}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(folder, sys.argv[2:]))
