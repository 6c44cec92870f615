"""Operators over edge rows, checked by expected rows that are written out beside them: cases of the tests, not queries."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdex.plans.registry import case


def literal(x: object) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, datetime.datetime):
        return f"TIMESTAMP '{x}'"
    if isinstance(x, datetime.date):
        return f"DATE '{x}'"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}"


def expected_sql(columns: str, rows: list[tuple]) -> str:
    """SQL that gives these rows; columns as `name type, ...` with DuckDB's types."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    cast = ", ".join(f"CAST(c{i} AS {k}) AS {n}" for i, (n, k) in enumerate(zip(names, kinds, strict=True)))
    values = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {values}) AS t({', '.join(f'c{i}' for i in range(len(names)))})"


def cases(name: str, columns: str, rows: list[tuple]) -> Callable[[Callable[[SparkSession], DataFrame]], Callable]:
    """Keep a case over literal rows with the rows that it must give."""

    def add(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark)

        run.__doc__ = f.__doc__
        case(name, expected_sql(columns, rows))(run)
        return f

    return add
