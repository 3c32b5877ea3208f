"""Compare a registered query with its SQL, value by value and in any row order.

Run as a script: ``python -m tests.oracle_check SF_DIR [KEY ...]``.
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e15 else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, sf_dir: str, key: str) -> str | None:
    """None if both sides agree exactly, else a short account of the first difference."""
    df = entry.queries()[key](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    relation = con.sql(entry.oracle_sql()[key])
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    mine, theirs = _rows(df.columns, got), _rows(relation.columns, relation.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows, such as {bad[0][0]} / {bad[0][1]}" if bad else None


def main(sf_dir: str, *keys: str) -> int:
    from shopsight.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for key, build in entry.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            if key in entry.oracle_sql():
                found = difference(spark, con, sf_dir, key) or "same"
            else:
                found = f"{len(build(spark, sf_dir).collect())} rows, no SQL"
        except Exception as error:  # report and go on with the next key
            found = f"ERROR {str(error)[:1500]}"
        failed += not (found == "same" or found.endswith("no SQL"))
        print(f"{key:26s} {time.time() - start:6.2f}s  {found}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
