"""Compare Spark and DuckDB results of the named queries.

``python tests/oracle_check.py <sf_dir> [name ...]``
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return repr(x)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    a = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = normal([d[0] for d in cur.description], cur.fetchall())
    if a == b:
        return None
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    left, right = [r for r in a[1] if r not in set(b[1])], [r for r in b[1] if r not in set(a[1])]
    return f"rows {len(a[1])} / {len(b[1])}; spark only {left[:2]}; duckdb only {right[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name not in sql:
                print(f"{name:34s} rows only: {len(query(spark, sf_dir).collect())}", flush=True)
                continue
            diff = compare(spark, con, name, query, sql[name], sf_dir)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name:34s} {time.time() - start:6.2f}s {'ok' if diff is None else 'DIFF ' + diff[:1200]}", flush=True)
