"""Every registered query against its SQL at the smallest scale."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from compare import compare, duck  # noqa: E402

from rungwork.plans.catalog import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, REGISTRY[name], SF) is None
