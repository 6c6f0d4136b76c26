"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

from innkeep.plans import catalog

from .conftest import SF_SMALL

NAMES = catalog.names()


@pytest.fixture(scope="module")
def duck():
    from tools.compare import duck as connect

    return connect(SF_SMALL)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    from tools.compare import compare

    ok, msg = compare(spark, SF_SMALL, name, duck, strict=True)
    assert ok, msg


def test_every_query_has_an_oracle():
    missing = [n for n in NAMES if catalog.oracle_sql(n) is None]
    assert missing == []
