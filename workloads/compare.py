"""Compare a query with its SQL on the same files, in an in-process DuckDB."""

from __future__ import annotations

import math

from .base import ORACLE, QUERIES, TABLES


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=lambda r: tuple(map(repr, r)))


def differences(spark, folder: str, name: str, connection=None) -> list[str]:
    """What differs between the query and its SQL; empty if nothing does."""
    connection = connection or connect(folder)
    frame = QUERIES[name](spark, folder)
    mine = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    answer = connection.execute(ORACLE[name])
    theirs = _rows([d[0] for d in answer.description], answer.fetchall())
    problems = []
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} and {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        problems.append(f"{len(mine[1])} and {len(theirs[1])} rows")
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            problems.append(f"{a} and {b}")
            break
    return problems
