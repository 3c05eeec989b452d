"""Every registered query: against its SQL where it has one, else it must give rows."""

from __future__ import annotations

import harness
import pytest

import __spark_entry__ as entry_point

SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return harness.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    if name in SQL:
        assert harness.compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_names_agree():
    assert set(SQL) <= set(entry_point.queries())
