"""Compare registered queries with their SQL: row count, columns and values.

Usage: python tests/compare.py <sf dir> [query ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    import numpy as np

    if value is None:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        f = float(value)
        if math.isnan(f):
            return None
        return int(f) if f.is_integer() else float(repr(f))
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(normal(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(rows, key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, build, sql: str) -> str | None:
    """None if equal, else the first difference."""
    df = build(spark, folder)
    cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols2, right = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != cols2:
        return f"columns {cols} / {cols2}"
    if len(left) != len(right):
        extra = next((r for r in left if r not in set(right)), None)
        other = next((r for r in right if r not in set(left)), None)
        return f"rows {len(left)} / {len(right)}; only left {extra}; only right {other}"
    if left != right:
        a, b = set(left), set(right)
        return f"values: {len(a - b)} differ; left {sorted(a - b, key=repr)[:2]} right {sorted(b - a, key=repr)[:2]}"
    return None


def main() -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, bad = duck(folder), 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        if name not in sqls:
            print(f"NOSQL {name} rows={queries[name](spark, folder).count()}", flush=True)
            continue
        try:
            diff = compare(spark, con, folder, name, queries[name], sqls[name])
        except Exception as e:  # noqa: BLE001
            diff = "error " + str(e)[:500].replace("\n", " | ")
        bad += diff is not None
        print(f"{'OK' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {(diff or '')[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
