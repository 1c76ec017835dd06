"""Every registered query against its check SQL."""

import harness
import pytest

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return harness.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_check_sql(spark, con, sf_dir, name):
    problem, _ = harness.compare(spark, con, QUERIES[name], CHECKS[name], sf_dir)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
