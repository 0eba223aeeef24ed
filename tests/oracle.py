"""Runs queries against their SQL in DuckDB on the same tables. python tests/oracle.py [sf] [names...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return list(map(norm, v)) if isinstance(v, list | tuple) else v


def rows(columns: list[str], data) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(repr([norm(r[i]) for i in order]) for r in data)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if they agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        more, less = got[1] - want[1], want[1] - got[1]
        return f"{sum(got[1].values())} and {sum(want[1].values())} rows; only here {list(more)[:3]}, only there {list(less)[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf), 0
    for name, sql in e.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            why = compare(spark, con, name, e.queries()[name], sql, sf)
        except Exception as ex:  # noqa: BLE001
            why = f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += why is not None
        print(f"{time.time() - t:5.1f}  {name}  {why or 'ok'}", flush=True)
    print(bad, "differ")
