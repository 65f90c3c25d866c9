"""Rows of a query and of its DuckDB twin in one form."""

import math
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def sorted_rows(rows, columns, order):
    places = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in places) for r in rows)


def compare(df, sql, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(kinds) == sorted(df.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    order = sorted(kinds)
    assert sorted_rows(df.collect(), df.columns, order) == sorted_rows(cursor.fetchall(), list(kinds), order)
