"""Every registered query against its SQL on the smallest test data."""

import os

import pytest

from checks.compare import differences
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    if name in ORACLES:
        assert differences(spark, SF, name) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0
