"""Queries that SQL can express give the same rows."""

import pytest
from oracle import compare, connect

from marlstone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF), registry.QUERIES[name], registry.ORACLES[name], SF) == ""
