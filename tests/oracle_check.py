"""Compares queries with their SQL: ``python tests/oracle_check.py [folder] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    return v


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got_cols, got = _canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = _canon(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        in_got, in_want = set(got), set(want)
        only_got = [r for r in got if r not in in_want][:3]
        only_want = [r for r in want if r not in in_got][:3]
        return f"{len(got)} vs {len(want)} rows\n   spark only: {only_got}\n   sql only:   {only_want}"
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP"}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if same.get(t) != kinds[c]}
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from trackspan.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        t = time.time()
        try:
            if name in sqls:
                note = compare(spark, con, name, fn, sqls[name], folder)
            else:
                note = None
                print("   rows only:", fn(spark, folder).count())
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += note is not None
        print(f"{'OK  ' if note is None else 'FAIL'} {name} {time.time() - t:.1f}s {note or ''}", flush=True)
        spark.catalog.clearCache()
    print("failed:", bad)
