"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    return columns, con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()


def normal(rows) -> list[str]:
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
        return str(v)

    return sorted(repr([one(v) for v in row]) for row in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, expected = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == columns
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(expected)
