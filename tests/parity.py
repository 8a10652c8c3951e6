"""Run registered queries in Spark and their statements in DuckDB and compare all rows.

    python -m tests.parity [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, statement: str) -> str | None:
    """None when schema and rows agree, else what differs."""
    expected = con.execute(statement)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    wanted = rows_of(names, expected.fetchall())
    got = rows_of(spark_df.columns, spark_df.collect())
    if wanted == got:
        return None
    missing, extra = wanted - got, got - wanted
    return (
        f"{sum(got.values())} rows, expected {sum(wanted.values())}; {sum(missing.values())} missing, {sum(extra.values())} extra\n"
        f"  columns  {sorted(names)}\n  expected {sorted(missing, key=str)[:2]}\n  got      {sorted(extra, key=str)[:2]}"
    )


def main(sf_dir: str, only: list[str]) -> int:
    from larder.session import build_session

    import __spark_entry__ as entry

    spark = build_session(
        "parity", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, statements, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, statements[name]) if name in statements else None if df.count() else "no rows"
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} differ: {bad}")
    return len(bad)


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(bool(main(directory, sys.argv[2:])))
