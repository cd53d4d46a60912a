"""Run every query next to its SQL and compare columns and values.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and (math.isnan(value) or value == 0):
        return None if math.isnan(value) else 0.0
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    got = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for g, w in zip(got[1], want[1]):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"row {g} != {w}"
    return f"ok {len(got[1])} rows" if got[1] else "ok but EMPTY"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tickscope.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session(master="local[8]", settings={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            if name in sql:
                verdict = compare(session, con, name, query, sql[name], sf_dir)
            else:
                verdict = f"no SQL, {query(session, sf_dir).count()} rows"
        except Exception as e:
            verdict = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:34s} {time.time() - began:6.2f}s {verdict[:900]}", flush=True)
