"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from tallywick import adapters
from tallywick.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert check.compare(spark, connection, SF, name).startswith("ok")


def test_state_names_of_cases_are_in_the_lookup(spark):
    """The state filter offers the lookup's names, so the cases must spell them alike."""
    cases, states = adapters.shape(spark, SF, "incidents"), adapters.shape(spark, SF, "states")
    assert cases.join(states, cases.State == states.State_Name, "left_anti").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
