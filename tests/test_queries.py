"""Every query of the catalogue against DuckDB, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from lodestone.plans import catalogue, worked
from tests.helpers import same_rows


@pytest.mark.parametrize("name", [*sorted(catalogue.QUERIES), *worked.QUERIES])
def test_query_matches_sql(name, spark, small, duck):
    query, sql = (catalogue.QUERIES | worked.QUERIES)[name], (catalogue.ORACLE | worked.ORACLE)[name]
    same_rows(query(spark, small), duck, sql)


def test_contract(spark):
    assert entry.entry(spark).count() >= 1
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
