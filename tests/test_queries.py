"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillspark.plans import catalogue
from quillspark.plans.stand_ins import TABLES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.sql(catalogue.ORACLE[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


#: No title of the smallest table is like another.
EMPTY = ("g02_duplicates",)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_other_queries_run(spark, name):
    found = catalogue.QUERIES[name](spark, SMALL)
    assert found.columns and (found.count() > 0) == (name not in EMPTY)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
