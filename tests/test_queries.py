"""Every registered query over whole small tables: it runs, and equals its SQL where there is one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module
import oracle

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    rows = oracle.rows_of_frame(df)
    if name in SQL:
        cols, want = oracle.rows_of_sql(con, SQL[name])
        assert sorted(df.columns) == cols
        assert rows == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
