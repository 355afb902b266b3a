import datetime as dt

import numpy as np
import pytest

from lonja.operators import windows
from lonja.plans import everything
from lonja.plans.reference import px
from oracle import DATA, assert_same

D = dt.date(2024, 1, 1)


@pytest.fixture
def prices(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(3):
        for i in range(80):
            if rng.random() < 0.9:
                rows.append((s, 1, D + dt.timedelta(i), None if rng.random() < 0.1 else int(rng.integers(900, 1100)) if s else 1000))
    return spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha date, p bigint")


def by_series(df):
    out = {}
    for r in df.orderBy("fecha").collect():
        out.setdefault(r.producto_id, []).append((r.fecha, r.p))
    return out


def test_robust_z(prices):
    got = {(r.producto_id, r.fecha): r.z for r in windows.robust_z(prices, "p").collect()}
    for s, rows in by_series(prices.where("p IS NOT NULL")).items():
        v = [x for _, x in rows]
        for i, (f, x) in enumerate(rows):
            h = np.array(v[max(0, i - 30) : i], float)
            if len(h) < 6:
                assert got[s, f] is None
                continue
            mad = np.median(np.abs(h - np.median(h))) * 1.4826
            scale = mad or h.std()
            if scale:
                assert np.isclose(got[s, f], (x - np.median(h)) / scale)
            else:
                assert got[s, f] == (None if x == np.median(h) else np.sign(x - np.median(h)) * 99)


def test_forecasts_use_the_past_alone(prices):
    for ahead in (1, 7):
        made = windows.forecasts(prices, "p", ahead).collect()
        series = {s: [x for _, x in rows] for s, rows in by_series(prices.where("p IS NOT NULL")).items()}
        assert made
        for r in made:
            y, t = np.array(series[r.producto_id], float), r.i
            assert r.n == len(y) and r.real == y[t + ahead] and r.estacional == y[t - 4]
            slope, cut = np.polyfit(range(5), y[t - 4 : t + 1], 1)
            assert np.isclose(r.tendencia, cut + slope * (4 + ahead))
            a = np.c_[y[: t + 1 - ahead], np.ones(t + 1 - ahead)]
            w = np.linalg.lstsq(a, y[ahead : t + 1], rcond=None)[0]
            assert np.isclose(r.ar1, w[0] * y[t] + w[1], rtol=1e-6)


def test_walk_forward_takes_the_chosen_origins(prices):
    made = windows.forecasts(prices, "p")
    got = {(r.producto_id, r.metodo): r for r in windows.walk_forward(made, ["estacional"], most=10).collect()}
    for s in range(3):
        rows = [r for r in made.collect() if r.producto_id == s]
        size = rows[0].n - 1 - 29
        chosen = {int(k * size / 10) for k in range(10)}
        e = [abs(r.estacional - r.real) for r in rows if r.i - 29 in chosen]
        assert got[s, "estacional"].origenes == len(e) == 10 and np.isclose(got[s, "estacional"].mae, np.mean(e))


def test_samples_runs_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, D + dt.timedelta(i), None if i in (3, 4) else i) for i in range(10)], "producto_id int, mercado_id int, fecha date, p bigint")
    assert sorted(r.p for r in windows.sampled(df, 4).collect() if r.p is not None) == [0, 6, 9]
    assert [(r.tramo, r.n) for r in windows.islands(df, "p").orderBy("tramo").collect()] == [(1, 3), (2, 5)]
    assert windows.median_gap(df).first().paso == 1.0
    assert [r.p for r in windows.tail(df, "p", 2).orderBy("p").collect()] == [8, 9]
    assert windows.latest(df).first().p == 9
    got = [r.q for r in df.withColumn("q", windows.carried("p")).orderBy("fecha").collect()]
    assert got == [0, 1, 2, 2, 2, 5, 6, 7, 8, 9]
    changes = [r.c for r in df.withColumn("c", windows.change("p")).orderBy("fecha").collect()]
    assert changes[1] is None and changes[2] == 1.0 and changes[5] == 1.5
    empty = df.limit(0)
    assert all(f.count() == 0 for f in (windows.latest(empty), windows.islands(empty, "p"), windows.robust_z(empty, "p"), windows.forecasts(empty, "p")))


def test_bands_of_large_errors(spark, tmp_path):
    """Squares of errors whose sum is beyond 64 bits."""
    rows = [(1, 1, D + dt.timedelta(i), dt.datetime(2025, 1, 1), 190.0 if i % 9 == 0 else 1.0 + i % 4, 1.0, None) for i in range(100)]
    spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha date, cargado_en timestamp, precio_hoy_kg double, masa_hoy double, tendencia string").write.parquet(f"{tmp_path}/precios_diarios.parquet")
    assert_same(spark, everything.QUERIES["w19_bands"], everything.SQL["w19_bands"], str(tmp_path))


def test_bands_take_every_origin(spark):
    got = {(r.producto_id, r.mercado_id): r.origenes for r in everything.QUERIES["w19_bands"](spark, DATA).collect()}
    made = windows.forecasts(px(spark, DATA), "p").groupBy("producto_id", "mercado_id").count().collect()
    assert got == {(r.producto_id, r.mercado_id): r["count"] for r in made} and max(got.values()) > 60
