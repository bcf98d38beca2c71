"""Columns with nulls as both sides of a comparison show them alike: numbers as doubles, verdicts as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shown(rows: DataFrame, numbers: tuple[str, ...] = (), verdicts: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumns({c: rows[c].cast("double") for c in numbers} | {c: rows[c].cast("string") for c in verdicts})


def shown_sql(sql: str, numbers: tuple[str, ...] = (), verdicts: tuple[str, ...] = ()) -> str:
    parts = [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in numbers] + [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in verdicts]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})"
