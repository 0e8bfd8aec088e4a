"""Run named queries next to their SQL and compare rows: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import io
import math
import os
import sys
import time
from contextlib import redirect_stdout

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_rows: list, spark_cols: list, sql_rows: list, sql_cols: list) -> str | None:
    """None if equal, else the first difference."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    order = sorted(spark_cols)
    a = sorted((tuple(r[spark_cols.index(c)] for c in order) for r in spark_rows), key=_sortable)
    b = sorted((tuple(r[sql_cols.index(c)] for c in order) for r in sql_rows), key=_sortable)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    for x, y in zip(a, b):
        for c, u, v in zip(order, x, y):
            if type(u) is not type(v):
                return f"{c}: {u!r} and {v!r} in {x} / {y}"
            if isinstance(u, float) and math.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12):
                continue
            if u != v:
                return f"{c}: {u!r} != {v!r} in {x} / {y}"
    return None


def check(
    spark: SparkSession, con, sf_dir: str, query, sql: str | None, inspect=None
) -> tuple[str | None, float, float, int]:
    """(first difference, Spark seconds, SQL seconds, rows) of one query."""
    start = time.time()
    df = query(spark, sf_dir)
    if inspect is not None:
        inspect(df)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if sql is None:
        return None, spark_s, 0.0, len(rows)
    start = time.time()
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    sql_rows = result.fetchall()
    return compare(rows, df.columns, sql_rows, cols), spark_s, time.time() - start, len(rows)


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, s, d, n = check(spark, con, sf_dir, query, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            problem, s, d, n = f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0.0, 0
        bad += problem is not None
        state = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{state:5} {name:32} {n:7} rows spark {s:6.2f}s sql {d:6.2f}s {problem or ''}", flush=True)
    unknown = set(oracles) - set(entry.queries())
    print(f"{bad} bad; sql without query: {unknown or 'none'}")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
