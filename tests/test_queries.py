"""Every registered query against its checking SQL."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].muni == "ARLINGTON"


def test_queries_and_sql_have_the_same_names():
    assert QUERIES.keys() == ORACLE.keys()
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.queries().keys() >= entry.oracle_sql().keys() >= ORACLE.keys()


def test_checking_sql_stands_by_itself():
    import workload.oracle
    import workload.tables

    for module in (workload.oracle, workload.tables):
        with open(module.__file__, encoding="utf-8") as file:
            assert "rentatlas" not in file.read()
