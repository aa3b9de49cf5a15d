"""Every query with SQL gives the same rows; the others run."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from marlstone.plans import catalogue

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return {sf: connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    said = compare(spark, con[SF], catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    if said == "no rows":  # that proves nothing: a larger table must give some
        said = compare(spark, con[LARGER], catalogue.QUERIES[name], catalogue.ORACLES[name], LARGER)
    assert said == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
