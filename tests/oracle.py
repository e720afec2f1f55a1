"""Run registered queries next to their SQL and compare. ``python tests/oracle.py [sf] [name ...]``"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


TIMES: dict[str, float] = {}


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else (int(value) if value.is_integer() else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(str(x) for x in r)
    )


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    start = time.time()
    df = query(spark, sf_dir)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    cursor = con.execute(sql)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    TIMES["sql"] = time.time() - start - TIMES["spark"]
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"columns {got_columns}\n  got  {str(a)[:600]}\n  want {str(b)[:600]}"
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from clearwake.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    session = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(session, con, folder, queries[name], oracles[name])
            else:
                problem = None if queries[name](session, folder).count() else "no rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {dict((k, round(v, 1)) for k, v in TIMES.items())} {problem or ''}", flush=True)
    print(f"{failed} failed")
