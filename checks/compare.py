"""Run queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from checks import all_queries
from gridtide.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """Value in a form that is equal for both engines."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def main(sf_dir: str, wanted: list[str]) -> int:
    queries, oracles = all_queries()
    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failures = 0
    names = list(queries)
    if wanted and wanted[0].startswith("from:"):
        names, wanted = names[names.index(wanted[0][5:]) :], []
    for name in names:
        run = queries[name]
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            result = run(spark, sf_dir)
            rows = [tuple(r) for r in result.collect()]
        except Exception as exc:  # noqa: BLE001
            failures += 1
            print(f"FAIL  {name}: {type(exc).__name__} {str(exc)[:600]}", flush=True)
            continue
        took = time.time() - began
        if name not in oracles:
            print(f"rows  {name}: {len(rows)} rows, {took:.1f}s", flush=True)
            continue
        began = time.time()
        try:
            answer = db.execute(oracles[name])
            columns, expected = [d[0] for d in answer.description], answer.fetchall()
        except Exception as exc:  # noqa: BLE001
            failures += 1
            print(f"FAIL  {name}: SQL {str(exc)[:600]}", flush=True)
            continue
        got, want = rows_of(result.columns, rows), rows_of(columns, expected)
        if sorted(result.columns) != sorted(columns):
            failures += 1
            print(f"FAIL  {name}: columns {sorted(result.columns)} != {sorted(columns)}", flush=True)
        elif got != want:
            failures += 1
            in_got, in_want = set(got), set(want)
            only_got = [r for r in got if r not in in_want][:3]
            only_want = [r for r in want if r not in in_got][:3]
            print(f"FAIL  {name}: {len(got)} rows, expected {len(want)}; {sorted(columns)}\n   only Spark {only_got}\n   only SQL   {only_want}", flush=True)
        else:
            print(f"ok    {name}: {len(rows)} rows, {took:.1f}s (sql {time.time() - began:.1f}s)", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    sys.exit(min(main(folder, arguments), 1))
