"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from vitaline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def test_entry_returns_labelled_patients(spark):
    df = entry.entry(spark)
    assert df.columns == ["idana", "idcentro", "label"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
