"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import check_oracle
from queries import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    good, note = check_oracle.compare(spark, duck, SF_DIR, name)
    assert good, note


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["bucket", "value"] and df.count() > 0


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(contract.queries()) and set(registry.ORACLES) <= set(contract.oracle_sql())
