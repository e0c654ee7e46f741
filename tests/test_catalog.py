"""Every registered query against its SQL."""

import pytest

from jobruns.plans.catalog import QUERIES
from jobruns.plans.oracle import ORACLE
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLE[name]) is None


def test_pinned_counts(spark):
    assert QUERIES["ready_jobs"](spark, SF).count() == 47
    assert QUERIES["ready_now"](spark, SF).count() == 23
    assert QUERIES["due_jobs"](spark, SF).count() == 44
    assert QUERIES["runs_without_job"](spark, SF).count() == 24
