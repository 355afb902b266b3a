import pytest

from lonja.plans import general
from oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(general.SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, general.QUERIES[name], general.SQL[name])


@pytest.mark.parametrize("name", sorted(set(general.QUERIES) - set(general.SQL)))
def test_runs(spark, name):
    assert general.QUERIES[name](spark, DATA).count() > 0
