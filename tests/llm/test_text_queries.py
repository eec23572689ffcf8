"""Every registered query of the text operators that SQL can express, against its SQL."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from vitaline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == []


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)
