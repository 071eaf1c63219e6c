"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("PRESSLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    ok, message = compare(spark, duck, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message
