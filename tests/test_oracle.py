"""Every registered query against its DuckDB counterpart."""

import pytest

import __spark_entry__ as club
from check_oracle import compare, oracle_connection
from oracle import oracle_queries
from palestra import catalog

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# empty on the smallest tables
NEED_MORE = {"v07_member_available_classes", "v07_available_classes_running",
             "v07_available_classes_sql", "x08_class_grid", "x10_find_machines", "d06_bookable_classes"}


@pytest.fixture(scope="module")
def connections():
    return {path: oracle_connection(path) for path in (SMALL, MIDDLE)}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_matches(spark, connections, name):
    path = MIDDLE if name in NEED_MORE else SMALL
    df = club.queries()[name](spark, path)
    rows, difference = compare(df, connections[path], name)
    assert difference == ""
    assert rows > 0
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_a_counterpart():
    assert set(oracle_queries()) == set(catalog.queries())
    assert set(oracle_queries()) <= set(club.oracle_sql()) and set(catalog.queries()) <= set(club.queries())


def test_entry(spark):
    assert club.entry(spark).count() == 139
