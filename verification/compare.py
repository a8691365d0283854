"""Run every registered query and its SQL twin on one folder of tables and compare the rows.

    python -m verification.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from tallymill.plans.catalog import QUERIES
from tallymill.session import local_session
from verification.oracle import ORACLE_SQL


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(value)) for value in row)


def same_rows(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text if both give the same bag of rows, else what differs."""
    result = connection.execute(sql)
    oracle_names = [item[0] for item in result.description]
    if sorted(oracle_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(oracle_names)}"
    names = sorted(oracle_names)
    at = [oracle_names.index(name) for name in names]
    wanted = sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=_key)
    found = sorted((tuple(row) for row in spark_df.select(*names).collect()), key=_key)
    if len(wanted) != len(found):
        return f"{len(found)} rows against {len(wanted)}"
    different = [(f, w) for f, w in zip(found, wanted) if repr(f) != repr(w)]  # repr tells -0.0 from 0.0
    if different:
        return f"{len(different)} of {len(found)} rows differ, first {different[0]} in {names}"
    return ""


def main(sf_dir: str, chosen: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failures = 0
    for name, query in QUERIES.items():
        if chosen and name not in chosen:
            continue
        start = time.perf_counter()
        if name in ORACLE_SQL:
            problem = same_rows(query(spark, sf_dir), connection, ORACLE_SQL[name])
        else:
            problem = "" if query(spark, sf_dir).count() else "no rows"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {time.perf_counter() - start:6.2f}s {problem}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
