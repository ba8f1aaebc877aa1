"""Compares a query with its SQL in DuckDB: columns, families of types and rows."""

import math
import os

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def family(kind: pa.DataType) -> str:
    """Whole numbers are one family whatever their width; text, dates and so on another each."""
    if pa.types.is_integer(kind):
        return "integer"
    if pa.types.is_floating(kind):
        return "floating"
    if pa.types.is_decimal(kind):
        return f"decimal {kind.scale}"
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return "string"
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return "binary"
    if pa.types.is_timestamp(kind):
        return "timestamp"
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"list of {family(kind.value_type)}"
    return str(kind)


def assert_same(df, db, sql: str) -> None:
    got, want = df.toArrow(), db.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert {f.name: family(f.type) for f in got.schema} == {f.name: family(f.type) for f in want.schema}
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
