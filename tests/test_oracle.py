"""Every registered query against its SQL twin, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_twin(spark, sf, con, name):
    assert compare(queries()[name], oracle_sql()[name], spark, sf, con) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_twin_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["host", "canonical", "captures", "raw_urls", "first_page_id"]
    assert df.count() > 0
