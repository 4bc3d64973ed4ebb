"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workloads.base import QUERIES
from workloads.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    assert name in entry.oracle_sql() and name in entry.queries()
    assert differences(spark, FOLDER, name, database) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 6
