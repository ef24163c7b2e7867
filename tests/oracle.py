"""Run a registered query and its oracle SQL and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain_rows, key=repr)


def compare(spark, con, name, query, sql, folder):
    """None when equal, otherwise what differs."""
    df = query(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    result = con.execute(sql)
    want = table([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} rows != {len(want[1])}\n{got[1][:3]}\n{want[1][:3]}"
    if got[1] != want[1]:
        pairs = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"{name}: {len(pairs)} rows differ, first {pairs[0]}"
    return "" if want[1] else f"{name}: no rows"


if __name__ == "__main__":
    from airgauge.session import build_session
    from workloads import ORACLES, QUERIES

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), folder)
        except Exception as error:
            problem = f"{name}: {type(error).__name__}: {str(error)[:1500]}"
        state = {None: "rows", "": "ok"}.get(problem, "BAD")
        print(f"{state:5}{time.time() - start:7.2f}s  {name}", flush=True)
        if problem:
            print("   ", problem, flush=True)
