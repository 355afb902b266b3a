import pytest

import edge
from lonja.plans import everything, general
from oracle import DATA, rows_of

QUERIES = everything.QUERIES
P = sorted(general.QUERIES)
#: Queries over given cases, besides or in place of the tables.
CASES = {"c02_masses", "s12_tables", "s34_state", "k10_keywords", "r10_parsed", "r01_corpus", "c05_figures", "f27_statements", "f34_signatures"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edge")
    return {name: make(spark, str(base / name)) for name, make in (("empty", edge.emptied), ("nulls", edge.with_nulls), ("more", edge.with_more_columns))}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - CASES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() <= 1  # totals of nothing may be one row


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_everywhere(spark, folders, name):
    df = QUERIES[name](spark, folders["nulls"])
    rows = df.collect()
    if name not in P:
        return
    again = QUERIES[name](spark, folders["nulls"]).collect()
    assert rows_of(df.columns, [list(r) for r in rows]) == rows_of(df.columns, [list(r) for r in again])


@pytest.mark.parametrize("name", P)
def test_further_columns_change_nothing(spark, folders, name):
    got, want = (QUERIES[name](spark, d) for d in (folders["more"], DATA))
    assert rows_of(got.columns, [list(r) for r in got.collect()]) == rows_of(want.columns, [list(r) for r in want.collect()])


@pytest.mark.parametrize("name", sorted(general.SQL))
def test_nulls_as_in_sql(spark, folders, name):
    from oracle import assert_same

    if name == "p1_found":
        pytest.skip("its SQL speaks of rows with a key; here rows with null keys are filled too")
    assert_same(spark, general.QUERIES[name], general.SQL[name], folders["nulls"])
