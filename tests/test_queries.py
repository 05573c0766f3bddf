"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check_queries
from shelfwatch import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    assert check_queries.compare(spark, duck, SF, name) == ""


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["title", "sold", "seller_count"] and df.count() == 20
