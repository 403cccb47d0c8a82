"""Every registered query against its SQL check in DuckDB, on whole tables."""

import compare
import pytest

import __spark_entry__ as entry
from tabaudit.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
# The queries of optional subpackages have tests of their own.
QUERIES = {name: run for name, run in entry.queries().items() if name in catalogue.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in catalogue.QUERIES}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return {folder: compare.connect(folder) for folder in (FOLDER, LARGER)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    problem = compare.compare(spark, duck[FOLDER], name, QUERIES[name], SQL[name], FOLDER)
    if problem == "no rows":  # too small a table to hold a single case
        problem = compare.compare(spark, duck[LARGER], name, QUERIES[name], SQL[name], LARGER)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
