"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from verdex.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE, CASES = registry.queries(), registry.oracle_sql(), registry.cases()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([repr(v) if isinstance(v, float) else str(v) for v in (r[i] for i in order)]) for r in got)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    told = duck.execute(ORACLE[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(CASES))
def test_edge_rows(spark, duck, name):
    run, expected = CASES[name]
    df, told = run(spark, SF), duck.execute(expected)
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, told.fetchall())


def test_queries_read_the_tables(spark):
    """No registered query runs on literal rows: cases are apart."""
    assert not set(QUERIES) & set(CASES) and set(ORACLE) <= set(QUERIES)


def test_all_have_an_expectation():
    assert set(QUERIES) - set(ORACLE) == {"pii_numbers", "pii_report", "ipv4_counts", "token_batches", "global_temperature", "drop_list_union", "released_rows"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
