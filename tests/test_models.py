import datetime as dt

import numpy as np

from lonja.operators import windows
from lonja.operators.boosting import boosted, features, refitted
from lonja.operators.models import compared, forecasted

D = dt.date(2024, 1, 1)


def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 1, D + dt.timedelta(2 * i), int(v), 100 + i % 7 if k != 2 else None) for k, n in ((1, 130), (2, 100), (3, 40)) for i, v in enumerate(1000 + rng.integers(-80, 80, n) + np.arange(n) * k)]
    rows.append((4, 1, D, None, None))
    return spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha date, p bigint, m bigint"), rows


def test_simple_models_are_those_of_the_windows(spark):
    df, _ = frame(spark)
    for h in (1, 7):
        got = {(r.producto_id, r.metodo): r for r in refitted(df, "p", "m", h, models=("estacional", "tendencia", "ar1")).collect()}
        want = {(r.producto_id, r.metodo): r for r in windows.walk_forward(windows.forecasts(df, "p", h), ("estacional", "tendencia", "ar1"), ahead=h).collect() if r.producto_id < 3}
        assert set(got) == set(want)
        assert all(abs(got[k].mae - want[k].mae) < 1e-3 and got[k].origenes == want[k].origenes for k in got)


def test_forecasts_of_dates_to_come(spark):
    df, rows = frame(spark)
    for h in (1, 7):
        got = {r.producto_id: r for r in forecasted(df, "p", "m", h).collect()}
        errors = {(r.producto_id, r.metodo): r for r in refitted(df, "p", "m", h, rows=60, models=("estacional", "tendencia", "gbm"), final=True).collect()}
        assert {k: r.metodo for k, r in got.items() if k > 2} == {3: "sin_datos", 4: "sin_datos"}
        last = [r[3] for r in rows if r[0] == 3][-1]
        assert (got[3].punto, got[3].desde, got[3].hasta, got[3].mae) == (last, last, last, None) and got[4].punto == 0
        for k in (1, 2):
            best = min((r for (i, _), r in errors.items() if i == k), key=lambda r: r.mae)
            assert got[k].metodo == best.metodo and got[k].mae == best.mae and got[k].mae_base == errors[k, "estacional"].mae
            assert got[k].punto == np.floor(best.punto + 0.5) and got[k].hasta == np.floor(got[k].punto + best.sigma + 0.5)
        assert (2, "gbm") not in errors
        y = np.array([r[3] for r in rows if r[0] == 1], float)
        assert errors[1, "estacional"].punto == y[-5]
        assert np.isclose(errors[1, "tendencia"].punto, np.polyval(np.polyfit(range(5), y[-5:], 1), 4 + h))
        day = np.array([(D - dt.date(1970, 1, 1)).days + 2 * i for i in range(len(y) + h)])
        x = features(np.r_[y, np.full(h, np.nan)], day, h, np.array([99999]))
        fit = ~np.isnan(x[: len(y)]).any(1)
        assert list(x[-1, :5]) == [y[-1], y[-2], y[-3], y[-5], y[-7]]
        assert abs(errors[1, "gbm"].punto - boosted(x[: len(y)][fit], y[fit], x[-1])) < 60  # these know no holidays


def test_horizons_side_by_side_are_those_one_by_one(spark):
    df, _ = frame(spark)
    for f, by in ((lambda h: refitted(df, "p", "m", h, rows=60, models=("tendencia", "gbm", "ar1_volumen"), final=True), "metodo"), (lambda h: forecasted(df, "p", "m", h), "n")):
        both = f((1, 7))
        assert "h" in both.columns
        got, want = both.collect(), [r.asDict() | {"h": h} for h in (1, 7) for r in f(h).collect()]
        place = lambda r: (r["producto_id"], r["h"], r[by])
        assert sorted((r.asDict() for r in got), key=place) == sorted(want, key=place)


def test_families(spark):
    df, _ = frame(spark)
    for h in (1, 7):
        got = {r.familia: r for r in compared(df, "p", "m", h).collect()}
        mae = {(r.producto_id, r.metodo): r.mae for r in refitted(df, "p", "m", h, rows=60, models=("estacional", "tendencia", "gbm", "ar1", "ar1_volumen")).collect()}
        base = [min(mae[k, "estacional"], mae[k, "tendencia"]) for k in (1, 2)]
        assert {f: (r.series, r.series_comun) for f, r in got.items()} == {"baseline": (2, 1), "ar1": (2, 1), "volumen": (1, 1), "gbm": (1, 1)}
        assert np.isclose(got["baseline"].mae, np.mean(base)) and got["baseline"].mae_comun == base[0] and got["baseline"].mejora == 0
        assert np.isclose(got["gbm"].mejora, 100 * (np.mean(base) - mae[1, "gbm"]) / np.mean(base))
        assert sorted(got, key=lambda f: got[f].rango) == sorted(got, key=lambda f: got[f].mae)
        assert [f for f in got if got[f].gana] == [min(got, key=lambda f: got[f].mae_comun)]
    alone = {r.familia: r for r in compared(df.where("producto_id = 2"), "p", "m").collect()}
    assert set(alone) == {"baseline", "ar1"} and alone["ar1"].series_comun == 1
