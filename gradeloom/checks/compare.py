"""Run queries beside their oracles: ``python -m gradeloom.checks.compare FOLDER [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from gradeloom.checks import load_queries
from gradeloom.checks.registry import oracle_queries, spark_queries
from gradeloom.checks.views import BASE_TABLES
from gradeloom.session import build_session


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_connection(folder: str):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> tuple[str, str]:
    start = time.time()
    df = query(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return "ROWS", f"{len(got)} rows {took:.1f}s"
    names = df.columns
    mine = rows_of(names, got)
    start = time.time()
    cursor = con.execute(sql)
    other_names = [d[0] for d in cursor.description]
    theirs = rows_of(other_names, cursor.fetchall())
    duck = time.time() - start
    if sorted(names) != sorted(other_names):
        return "COLUMNS", f"{sorted(set(names) ^ set(other_names))}"
    if mine != theirs:
        mine_set, their_set = set(mine), set(theirs)
        only = [r for r in mine if r not in their_set][:2]
        missing = [r for r in theirs if r not in mine_set][:2]
        return "DIFF", f"{len(mine)} vs {len(theirs)} {sorted(names)}\n   spark {only}\n   duck  {missing}"
    return "OK", f"{len(got)} rows {took:.1f}s (oracle {duck:.1f}s)"


def main(argv: list[str]) -> int:
    folder, wanted = argv[0], argv[1:]
    load_queries()
    spark = build_session(8, 8)
    con = oracle_connection(folder)
    queries, oracles = spark_queries(), oracle_queries()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, detail = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            status, detail = "ERROR", str(error)[:900]
        bad += status not in ("OK", "ROWS")
        print(f"{status:8} {name} {detail}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
