"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from check import connect, difference

from quarrystat.plans import ORACLES, QUERIES

NAMES = list(QUERIES)
BARE = [n for n in NAMES if n not in ORACLES]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, con.execute(entry.oracle_sql()[name]).fetchdf()) is None


def test_bare_queries_are_known():
    """Some queries of iterative learners have no SQL twin (others of the same operators do)."""
    assert set(BARE) == {"logreg_error", "logreg_auc_sweep", "svm_accuracy", "forest_fit", "forest_importance"}


@pytest.mark.parametrize("name", BARE)
def test_bare_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry_ranks_every_dimension(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r["j"] for r in rows) == list(range(64))
    assert [r["mi"] for r in rows] == sorted((r["mi"] for r in rows), reverse=True)


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(NAMES) <= set(entry.queries())
