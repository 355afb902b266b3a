import pytest

import edge
from lonja.llm import queries
from oracle import DATA, rows_of


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edge")
    return {name: make(spark, str(base / name)) for name, make in (("empty", edge.emptied), ("nulls", edge.with_nulls), ("more", edge.with_more_columns))}


def rows(df):
    return rows_of(df.columns, [list(r) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_everywhere(spark, folders, name):
    if name == "p9_containers":  # which of equal items lies where is decided by their key
        assert queries.QUERIES[name](spark, folders["nulls"]).count() > 0
        return
    assert rows(queries.QUERIES[name](spark, folders["nulls"])) == rows(queries.QUERIES[name](spark, folders["nulls"]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_further_columns_change_nothing(spark, folders, name):
    assert rows(queries.QUERIES[name](spark, folders["more"])) == rows(queries.QUERIES[name](spark, DATA))
