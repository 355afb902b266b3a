import numpy as np
import pytest

from lonja.operators.impute import Field, Mixture, fill
from lonja.operators.usable import MASS, PRICE, Range

FIELDS = [Field("a", MASS, "m", 0.1), Field("a", MASS, "m", 0.1, -1), Field("b", MASS, "m", 0.1), Field("p", PRICE, "p")]
SCHEMA = "producto_id int, mercado_id int, fecha date, a double, b double, p double, c string, marca string"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def series(n=60, seed=0):
    import datetime as dt

    rng = np.random.default_rng(seed)
    rows = []
    for s in range(6):
        level = rng.uniform(1, 5)
        walk = np.cumsum(rng.normal(0, 0.2, n)) * 0.3
        for i in range(n):
            a = float(np.exp(level + walk[i]))
            rows.append([s, 1, dt.date(2024, 1, 1) + dt.timedelta(i), a, a * 1.02, float(np.exp(-walk[i] / 2)), "alza" if walk[i] > 0 else "baja", "x"])
    return rows


def test_held_out_values_come_back(spark):
    rows = series()
    rng = np.random.default_rng(1)
    hidden = {}
    for i in rng.choice(len(rows), 40, replace=False):
        hidden[tuple(rows[i][:3])] = rows[i][3]
        rows[i][3] = [None, float("nan"), -99.0, 99999.0][i % 4]
    out = fill(made(spark, rows), FIELDS, ["a"], "c").collect()
    assert len(out) == len(rows)
    errors = []
    for r in out:
        k = (r.producto_id, r.mercado_id, r.fecha)
        assert r.a_relleno == (k in hidden)
        if k in hidden:
            errors.append(abs(np.log(r.a / hidden[k])))
    assert np.median(errors) < 0.05
    spread = np.std([np.log(r[3]) for r in series()])
    assert max(errors) < spread


def test_category_takes_its_likeliest_level(spark):
    rows = series()
    truth = {tuple(r[:3]): r[6] for r in rows[::9]}
    for r in rows[::9]:
        r[6] = None
    out = [r for r in fill(made(spark, rows), FIELDS, ["a"], "c").collect() if r.c_relleno]
    assert {(r.producto_id, r.mercado_id, r.fecha) for r in out} == set(truth)
    assert np.mean([truth[r.producto_id, r.mercado_id, r.fecha] == r.c for r in out]) > 0.6


def test_nulls_ties_and_empty_tables(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    rows = [
        (None, 1, d, 5.0, 5.0, 1.0, None, "x"),
        (1, None, None, None, None, None, None, None),
        (1, 1, d, 0.0, None, 0.0, "alza", "x"),
        (2, 1, d, None, None, None, None, "x"),
        (2, 1, d, None, None, None, None, "x"),
    ]
    out = fill(made(spark, rows), FIELDS, ["a", "p"], "c").collect()
    assert len(out) == len(rows)
    assert sorted((r.a_relleno, r.p_relleno) for r in out) == [(False, False), (False, True), (True, True), (True, True), (True, True)]
    assert all(r.a is not None and r.p is not None for r in out)
    zero = next(r for r in out if r.producto_id == 1 and r.mercado_id == 1)
    assert zero.a == 0.0 and zero.p > 0
    assert fill(made(spark, []), FIELDS, ["a"], "c").count() == 0
    nothing = fill(made(spark, rows[3:4]), FIELDS, ["a"], "c").collect()
    assert nothing[0].a is None and nothing[0].a_relleno


def test_too_many_levels_are_refused(spark):
    rows = [r[:6] + [str(i), "x"] for i, r in enumerate(series(20))]
    with pytest.raises(ValueError):
        fill(made(spark, rows), FIELDS, ["a"], "c")


def test_statistics_add_up_and_likelihood_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.8, 0], [0, 0.5, 0.3], [0, 0, 0.2]])
    x[rng.random(x.shape) < 0.2] = np.nan
    cat = [rng.integers(-1, 3, 500)]
    m = Mixture.start(np.zeros(3), np.ones(3), [3], 3)
    whole = m.statistics(x, cat)
    halves = m.statistics(x[:200], [cat[0][:200]]) + m.statistics(x[200:], [cat[0][200:]])
    assert np.allclose(whole, halves)
    for _ in range(8):
        m = m.maximised(m.statistics(x, cat))
    assert all(b > a - 1e-6 * abs(a) for a, b in zip(m.loglik, m.loglik[1:]))


def test_conditional_mean_of_one_gaussian():
    cov = np.array([[2.0, 0.9], [0.9, 1.0]])
    m = Mixture(np.ones(1), np.array([[1.0, -1.0]]), cov[None], [])
    _, filled, spread, _ = m.expect(np.array([[np.nan, 0.5]]), [])
    assert np.isclose(filled[0, 0, 0], 1 + 0.9 * 1.5)
    assert np.isclose(spread[0][2][0, 0, 0], 2 - 0.81)


def test_range_of_arrays_and_columns(spark):
    values = [None, float("nan"), -1.0, 0.0, 1.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in (Range(0, 10), Range(0, 10, open=True)):
        got = [x[0] for x in df.select(r.usable("v")).collect()]
        assert got == r.mask(np.array([np.nan if v is None else v for v in values])).tolist()
