"""Every registered query of the engine against its SQL twin."""

import pytest
from attestra import catalog

from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score", "n_scored", "level"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
