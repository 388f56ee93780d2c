"""Run a query in Spark and its oracle in DuckDB and compare them row by row."""

from __future__ import annotations

import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Spark type name -> DuckDB type name, for the schema check.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
         "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        file = Path(sf_dir) / f"{name}.parquet"
        if file.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def oracle_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    return names, types, result.fetchall()


def differences(df, con, sql: str) -> tuple[list[str], int, float, float]:
    """Problems found (none = equal), row count, seconds of Spark and of DuckDB."""
    start = time.time()
    rows = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    start = time.time()
    names, types, expected = oracle_rows(con, sql)
    duck_seconds = time.time() - start
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} <> {sorted(names)}"], len(rows), spark_seconds, duck_seconds
    for name, dtype in df.dtypes:
        found = types[names.index(name)]
        if TYPES.get(dtype) != found:
            problems.append(f"type of {name}: {dtype} <> {found}")
    order = [names.index(c) for c in df.columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine = sorted(rows, key=key)
    theirs = sorted((tuple(r[i] for i in order) for r in expected), key=key)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} <> {len(theirs)}")
    if mine != theirs:
        only_mine = sorted(set(mine) - set(theirs), key=key)[:2]
        only_theirs = sorted(set(theirs) - set(mine), key=key)[:2]
        problems.append(f"values: spark {only_mine} oracle {only_theirs}")
    return problems, len(rows), spark_seconds, duck_seconds
