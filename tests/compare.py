"""Spark rows against DuckDB rows: same columns, kinds and values, in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"create view {name} as select * from '{path if path.is_file() else path / '*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return bytes(x) if isinstance(x, bytearray) else x


def key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def differences(df, con, sql, limit=5):
    """None where both agree, else what differs."""
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} and {sorted(rel.columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]"}
    spark_kinds, duck_kinds = dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types)))
    if odd := {c: (spark_kinds[c], duck_kinds[c]) for c in cols if kinds.get(spark_kinds[c]) != duck_kinds[c]}:
        return f"kinds {odd}"
    a = sorted((plain(tuple(r[c] for c in cols)) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    b = sorted((plain(tuple(r[i] for i in at)) for r in rel.fetchall()), key=key)
    if a != b:
        x, y = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} and {len(b)}; only Spark {list(x)[:limit]}; only SQL {list(y)[:limit]}"
    return None if a else "no rows"
