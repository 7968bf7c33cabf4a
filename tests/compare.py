"""Run registered queries against DuckDB and compare whole results.

``python -m tests.compare [sf] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, sf) -> tuple[bool, str]:
    started = time.time()
    df = build(spark, f"{DATA}/sf{sf}")
    got = df.collect()
    took = time.time() - started
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    note = f"{len(got)} rows, {took:.1f}s (duckdb {time.time() - started:.1f}s)"
    if sorted(df.columns) != sorted(names):
        return False, f"{note}; columns {sorted(df.columns)} vs {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return False, f"{note} vs {len(want)}; {sorted(names)}; only spark {only_a}; only sql {only_b}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    odd = {n: (t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n]}
    return True, note + (f"; types {odd}" if odd else "")


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from wireloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark, con, sqls = local_session(8), connect(sf), oracle_sql()
    bad = []
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            if name in sqls:
                ok, note = compare(spark, con, name, build, sqls[name], sf)
            else:
                started = time.time()
                ok, note = True, f"{build(spark, f'{DATA}/sf{sf}').count()} rows (no sql) {time.time() - started:.1f}s"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("RESULT", "ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("RESULT failed:", bad)


if __name__ == "__main__":
    main()
