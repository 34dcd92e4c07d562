"""Every registered query of the library against its oracle SQL at the smallest scale."""

import pytest

from comparing import assert_matches
from strataframe import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    assert_matches(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_surfaces_are_closed_and_outward(spark, sf_dir):
    for row in catalog.QUERIES["surfaces"](spark, sf_dir).collect():
        assert row.closed and row.volume > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
