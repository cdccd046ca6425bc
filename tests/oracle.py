"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def compare(df, con, sql: str) -> str:
    """'' if both give the same columns and rows, in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    ours = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in ours), key=repr)
    at = [names.index(c) for c in sorted(names)]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in theirs), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; only ours {[x for x in a if x not in b][:2]}; only theirs {[x for x in b if x not in a][:2]}"
    if a != b:
        x, y = next((x, y) for x, y in zip(a, b) if x != y)
        return f"{sum(x != y for x, y in zip(a, b))} rows differ, as {x} and {y}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in result.description}
    return ", ".join(f"{c}: {t} against {types[c]}" for c, t in df.dtypes if types[c] not in ("NUMBER", "STRING", "bool") and kinds.get(t, types[c]) != types[c])
