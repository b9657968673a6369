"""Compare a named query with its SQL."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR", "BooleanType": "BOOLEAN",
    "ShortType": "SMALLINT", "FloatType": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL's result; empty when nothing does."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = canonical(cursor.fetchall(), names)
    found = canonical([tuple(r) for r in df.collect()], df.columns)
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    for field in df.schema.fields:
        kind = KINDS.get(type(field.dataType).__name__, str(field.dataType))
        if field.name in kinds and kinds[field.name] not in (kind, f"DuckDBPyType({kind})") and not isinstance(field.dataType, T.ArrayType):
            problems.append(f"type of {field.name}: {kind} against {kinds[field.name]}")
    if len(found) != len(expected):
        problems.append(f"{len(found)} rows against {len(expected)}")
    if found != expected:
        a, b = set(found) - set(expected), set(expected) - set(found)
        problems.append(f"{len(a)} rows only here {sorted(a)[:3]}, {len(b)} only there {sorted(b)[:3]}")
    return problems
