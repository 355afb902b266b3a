import datetime as dt

import numpy as np

from lonja.operators.grid import on_cells, regular, running_total

D = dt.date(2024, 1, 1)
SCHEMA = "producto_id int, mercado_id int, fecha date, v double, sin_lectura string"


def day(i):
    return D + dt.timedelta(i)


def test_resets_and_shares():
    value, at = np.array([10.0, 14.0, 2.0, 8.0]), np.array([0, 4, 6, 9])
    total = running_total(value, np.zeros(4, int))
    assert total.tolist() == [0, 4, 6, 12]
    got = on_cells(at, total, np.zeros(4, int), np.arange(0, 11), np.zeros(11, int))
    assert np.isnan(got[[0, 10]]).all()
    assert np.allclose(got[1:10], [1, 1, 1, 1, 1, 1, 2, 2, 2])
    weekly = on_cells(at, total, np.zeros(4, int), np.array([3, 6, 9]), np.zeros(3, int), width=3)
    assert np.allclose(weekly, [3, 3, 6]) and np.isclose(weekly.sum(), total[-1])


def test_levels_on_the_days_of_the_market(spark):
    rows = [(1, 1, day(0), 5.0, "x"), (1, 1, day(3), 8.0, "x"), (1, 1, day(4), None, "x"), (1, 1, day(6), float("nan"), "x"), (2, 1, day(2), 1.0, "x"), (2, 1, day(5), 1.0, "x"), (2, 1, day(9), 1.0, "x")]
    rows += [(None, 1, day(0), 1.0, "x"), (1, None, day(0), 1.0, "x"), (1, 1, None, 1.0, "x")]
    got = {(r.producto_id, r.fecha): (r.v, r.sin_lectura) for r in regular(spark.createDataFrame(rows, SCHEMA), "v").collect()}
    assert got == {
        (1, day(0)): (5.0, False),
        (1, day(2)): (8.0, True),
        (1, day(3)): (8.0, False),
        (1, day(4)): (None, True),
        (1, day(5)): (None, True),
        (1, day(6)): (None, True),
        (2, day(2)): (1.0, False),
        (2, day(3)): (1.0, True),
        (2, day(4)): (1.0, True),
        (2, day(5)): (1.0, False),
        (2, day(6)): (1.0, True),
        (2, day(9)): (1.0, False),
    }


def test_counters_and_long_gaps(spark):
    rows = [(1, 1, day(i), v, "x") for i, v in ((0, 100.0), (2, 110.0), (3, 4.0), (9, 16.0))] + [(2, 1, day(i), 1.0, "x") for i in range(10)]
    got = {r.fecha: (r.v, r.sin_lectura) for r in regular(spark.createDataFrame(rows, SCHEMA), "v", kind="counter", longest=5).collect() if r.producto_id == 1}
    assert got[day(0)] == (None, False) and got[day(1)] == (5.0, True) and got[day(2)] == (5.0, False) and got[day(3)] == (4.0, False)
    assert got[day(5)] == (None, True) and got[day(9)] == (2.0, False)


def test_empty_and_no_values(spark):
    assert regular(spark.createDataFrame([], SCHEMA), "v").count() == 0
    got = regular(spark.createDataFrame([(1, 1, day(0), None, "x"), (1, 1, day(1), None, "x")], SCHEMA), "v").collect()
    assert [(r.v, r.sin_lectura) for r in got] == [(None, True)] * 2
