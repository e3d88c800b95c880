"""Every named query against its check text on the smallest tables."""

import pytest

from cohortspark.plans.catalog import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name)
    assert ok, message


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["group", "phase", "n_series", "n_patients"]
