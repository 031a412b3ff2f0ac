"""Compare Spark results with DuckDB results for the same query, order-insensitively.

Run as ``python tests/compare.py <sf_dir> [name-prefix ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(value):
    if value is None:
        return None
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((str(k), canon(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(canon(v) for v in value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def compare(df, con, sql):
    """None when equal, else a short text saying how they differ; second item is the row count."""
    left_cols, left = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}", len(left)
    if len(left) != len(right):
        return f"row counts {len(left)} != {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first:\n    spark {str(bad[0][0])[:700]}\n    duck  {str(bad[0][1])[:700]}", len(left)
    return None, len(left)


def main(sf_dir, prefixes):
    from pyspark.sql import SparkSession

    import __spark_entry__ as se

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = se.oracle_sql()
    failed = 0
    for name, fn in se.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        begin = time.time()
        try:
            if name in sqls:
                problem, n = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                n, problem = fn(spark, sf_dir).count(), None
        except Exception as error:
            lines = [line for line in str(error).split("\n") if line.strip() and not line.strip().startswith("at ")]
            problem, n = "error: " + " | ".join(lines)[:900], -1
        failed += problem is not None
        status = "FAIL" if problem else ("ok" if name in sqls else "rows")
        if problem or n == 0 or "-v" in sys.argv:
            print(f"{status:5}{name} n={n} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print("failed:", failed, flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [a for a in sys.argv[2:] if a != "-v"])
