"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from shopsight.plans import oracle, queries
from tests.oracle_check import connect, difference

ROWS_ONLY = {"propensity", "confusion", "propensity_deciles", "model_compare", "cv_accuracy", "forest_sweep",
             "coefficients", "grid_search"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, sf_dir, key):
    assert difference(spark, con, sf_dir, key) is None


def test_keys():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 7
