"""Every registered query that SQL can check, against SQL on the same tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

SQL = oracle_sql()


@pytest.mark.parametrize("key", list(SQL))
def test_query_matches_sql(spark, con, sf_dir, key):
    _, verdict = compare(spark, con, sf_dir, key, SQL[key])
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 13
