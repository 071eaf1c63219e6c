"""Runs a checked query on Spark and its SQL on DuckDB and compares the rows as multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message)"""
    df = fn(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(spark_rows)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, spark_rows), _rows(names, duck_rows)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"{len(spark_rows)} vs {len(duck_rows)} rows\n   spark only ({sum((a-b).values())}): {only_a}\n   sql only: {only_b}"
    return True, f"{len(spark_rows)} rows"


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from pressloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            ok, message = compare(spark, con, q[name], o.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001  the report goes on with the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
