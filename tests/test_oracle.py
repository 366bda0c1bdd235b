"""Every query against its SQL, on the smallest tables."""

import pytest

from seqloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(catalogue.QUERIES[name], catalogue.SQL[name])


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"orf_viterbi"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
