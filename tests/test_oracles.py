"""Every registered query against its oracle SQL, or for rows where it has none."""

from __future__ import annotations

import os

import pytest

from kiteloom.plans import registry
from tests.compare import difference, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= registry.queries().keys()
