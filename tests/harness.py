"""Compares a registered query with its oracle on the driver's tables."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("STROM_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{folder}/{name}')")
    return con


def kind(series: pd.Series) -> str:
    for value in series:
        if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
            continue
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return "bool"
        if isinstance(value, (dt.datetime, pd.Timestamp)):
            return "timestamp"
        if isinstance(value, dt.date):
            return "date"
        if isinstance(value, str):
            return "text"
        if type(value).__name__.startswith(("int", "uint")):
            return "int"
        if type(value).__name__ == "Decimal":
            return "decimal"
        return "float" if isinstance(value, float) else type(value).__name__
    return "null"


def cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, (dt.datetime, pd.Timestamp)):
        return pd.Timestamp(value).isoformat()
    if type(value).__name__.startswith(("int", "uint")) or isinstance(value, float):
        return repr(float(value))
    return str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in data)


SPARK_KINDS = {
    "string": "text", "double": "float", "float": "float", "bigint": "int64", "int": "int32", "boolean": "bool",
    "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date",
}
DUCK_KINDS = {
    "VARCHAR": "text", "DOUBLE": "float", "BIGINT": "int64", "INTEGER": "int32", "BOOLEAN": "bool",
    "TIMESTAMP": "timestamp", "DATE": "date",
}


def compare(spark, con, name: str, query, sql: str, folder: str = SF_DIR) -> tuple[str, str]:
    """('ok' or a short verdict, detail)."""
    start = time.time()
    df = query(spark, folder)
    spark_types = {f.name: SPARK_KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    got = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_types = {d[0]: DUCK_KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    want = cursor.fetchall()
    note = f"{len(got)} rows, spark {spark_seconds:.1f}s duck {time.time() - start:.1f}s"
    if set(names) != set(df.columns):
        return "columns", f"{note}: only spark {sorted(set(df.columns) - set(names))}, only oracle {sorted(set(names) - set(df.columns))}"
    differing = {c: (spark_types[c], duck_types[c]) for c in names if spark_types[c] != duck_types[c]}
    if len(got) != len(want):
        return "rows", f"{note}: oracle has {len(want)}"
    a, b = rows(df.columns, got), rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        columns = sorted(names)
        x, y = bad[0]
        detail = [(columns[i], x[i], y[i]) for i in range(len(columns)) if x[i] != y[i]][:6]
        count = {c: sum(p[i] != q[i] for p, q in bad) for i, c in enumerate(columns)}
        return "values", f"{note}: {len(bad)} rows differ, first {detail}, per column { {k: v for k, v in count.items() if v} }"
    if differing:
        return "types", f"{note}: {differing}"
    return ("ok" if got else "empty"), note


def main(argv: list[str]) -> int:
    from strom.registry import all_oracles, all_queries
    from strom.session import local_session

    folder = SF_DIR
    queries, oracles = all_queries(), all_oracles()
    wanted = [q for q in queries if not argv or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in argv)]
    spark, con = local_session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    failures = 0
    for name in wanted:
        try:
            if name in oracles:
                verdict, detail = compare(spark, con, name, queries[name], oracles[name], folder)
            else:
                start = time.time()
                n = len(queries[name](spark, folder).collect())
                verdict, detail = ("ok" if n else "empty"), f"{n} rows, no oracle, {time.time() - start:.1f}s"
        except Exception as error:  # report and go on with the next query
            verdict, detail = "error", str(error)[:900]
        failures += verdict != "ok"
        print(f"{verdict:8} {name}: {detail}", flush=True)
    print(f"{len(wanted)} queries, {failures} not ok")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
