"""Side-by-side run of registered queries on Spark and their SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, _rows([tuple(r) for r in frame.collect()], [frame.columns.index(n) for n in names])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    return names, _rows(result.fetchall(), [columns.index(n) for n in names])
