"""Run registered queries beside their SQL check in DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=lambda r: [(x is None, type(x).__name__, x if x is not None else 0) for x in r])


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    index = [columns.index(c) for c in names]
    return names, sorted((tuple(_plain(r[i]) for i in index) for r in cur.fetchall()), key=lambda r: [(x is None, type(x).__name__, x if x is not None else 0) for x in r])


def compare(spark, con, name, run, sql, folder):
    """None when equal, else a short description of the difference."""
    s_names, s_rows = rows_of_spark(run(spark, folder))
    d_names, d_rows = rows_of_duck(con, sql)
    if s_names != d_names:
        return f"columns differ: {s_names} / {d_names}"
    if len(s_rows) != len(d_rows):
        return f"{len(s_rows)} rows / {len(d_rows)} rows; first only-left {next((r for r in s_rows if r not in set(d_rows)), None)}"
    for a, b in zip(s_rows, d_rows):
        if repr(a) != repr(b):
            return f"values differ\n  spark {dict(zip(s_names, a))}\n  sql   {dict(zip(d_names, b))}"
    return None if s_rows else "no rows"


def main(folder: str, only: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, run, sqls[name], folder)
            else:
                problem = None if run(spark, folder).count() >= 0 else "failed"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
