"""Compare a Spark result with the checking SQL: names, types, rows and values."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, as readable lines; empty when both sides agree."""
    names = sorted(df.columns)
    spark_types = {n: TYPE_NAMES.get(t, t) for n, t in df.dtypes}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if names != sorted(described):
        return [f"columns {names} against {sorted(described)}"]
    problems = [
        f"type of {n}: {spark_types[n]} against {described[n]}"
        for n in names if spark_types[n] != described[n]
    ]
    left = Counter(tuple(r) for r in df.select(*names).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    right = Counter(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
    if left != right:
        problems.append(f"rows {left.total()} against {right.total()}")
        problems += [f"only in Spark: {r}" for r in list((left - right))[:3]]
        problems += [f"only in SQL: {r}" for r in list((right - left))[:3]]
    return problems
