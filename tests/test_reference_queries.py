import pytest

from lonja.plans import everything, general
from oracle import DATA, assert_same

QUERIES, SQL = ({k: v for k, v in x.items() if k not in general.QUERIES} for x in (everything.QUERIES, everything.SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
