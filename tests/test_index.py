import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.functions.vectors import dot, normalised, quantised, restored
from lonja.operators.index import closed, hashed, missing, read_index, write_index


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "Papá amarilla"), (2, "papa AMARILLA, papa amarilla"), (3, "a de"), (4, None), (5, "yuca")], "i int, t string")
    got = {r.i: np.array(r.v) for r in hashed(df, "i", "t", 32).collect()}
    assert np.allclose(got[1], got[2]) and np.isclose(np.linalg.norm(got[1]), 1) and not got[3].any() and not got[4].any()
    assert not np.allclose(got[1], got[5])


def test_round_trip_by_parts(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, "historico", [0.6, -0.8]), (2, "reciente", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, parte string, v array<double>")
    write_index(df, path, "fija:2")
    write_index(spark.createDataFrame([(3, "reciente", [0.0, 1.0])], df.schema), path, "fija:2")
    got = {r.i: r.v for r in read_index(spark, path, "fija:2").collect()}
    assert set(got) == {1, 3} and np.allclose(got[1], [0.6, -0.8], atol=1 / 254)
    with pytest.raises(ValueError):
        read_index(spark, path, "otra:2")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.n for r in df.select(normalised("v").alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(dot("v", "v").alias("d")).first().d == 25.0
    q = spark.createDataFrame([([1.5, -2.0, 0.5 / 127, 1.5 / 127],)], "v array<double>").select(quantised("v").alias("q"))
    assert list(q.first().q) == [127, -127, 0, 2]
    assert q.select(restored("q").alias("r")).first().r[0] == 1.0


def test_missing_and_closed(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, t string")
    known = missing(chunks, spark.createDataFrame([], "i int, huella string"), "i", "t").where("i < 3")
    again = missing(spark.createDataFrame([(1, "a"), (2, "nuevo"), (3, None)], "i int, t string"), known, "i", "t")
    assert sorted(r.i for r in again.collect()) == [2, 3]
    days = spark.createDataFrame([(dt.date(2026, 8, 9),), (dt.date(2026, 8, 10),), (None,)], "f date")
    assert [r.c for r in days.select(closed("f", F.lit(dt.date(2026, 8, 14))).alias("c")).collect()] == [True, False, False]
