"""All queries of the engine, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
#: Edge rows of the operators, written out, with the rows that they must give; for tests alone, as they read no table.
_CASES: dict[str, tuple[Query, str]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows where there is one."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLE[name] = oracle
        return f

    return add


def case(name: str, expected: str) -> Callable[[Query], Query]:
    """Keep a function over edge rows under a name, with the SQL of what it must give."""

    def add(f: Query) -> Query:
        if name in _CASES:
            raise ValueError(f"case {name} is there twice")
        _CASES[name] = (f, expected)
        return f

    return add


def _load() -> None:
    from verdex.plans import applied, contamination, curation, curation_cases, decision_cases, exact_cases, generated, item_cases, logs, metrics, privacy, projections, relational, relations, releases, rule_cases, rules, searches, sequences, streams, suites, text_cases  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def cases() -> dict[str, tuple[Query, str]]:
    """Operators over edge rows, with SQL of the rows expected: what the tests run besides the queries."""
    _load()
    return dict(_CASES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
