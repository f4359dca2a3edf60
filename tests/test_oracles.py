"""Every registered query with an oracle equals its SQL on whole tables."""

import pytest

import __spark_entry__ as entry
from workloads.check import compare

ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, sf, key):
    assert compare(spark, sf, entry.queries()[key], ORACLES[key]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 3
