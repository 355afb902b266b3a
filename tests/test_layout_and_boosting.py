import datetime as dt
import random

import numpy as np

from lonja.operators.boosting import best_split, boosted, boosted_each, features, origins, refitted
from lonja.operators.layout import clustered, fingerprint, in_bands, joined, longest_prefix, split_letters


def test_rows_by_anchor(spark):
    words = [("d", 1, "a", 10.0, 100.0), ("d", 1, "b", 50.0, 102.9), ("d", 1, "c", 20.0, 105.0), ("d", 1, "e", 30.0, 101.0), ("d", 2, "f", 1.0, 100.0), ("d", 1, "x", None, 100.0)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, top double")
    got = {r.text: r.renglon for r in clustered(df, ["doc", "page"], "top", "x0").collect()}
    assert got == {"a": 0, "e": 0, "b": 0, "c": 1, "f": 0}
    assert clustered(df.limit(0), ["doc", "page"], "top", "x0").count() == 0


def test_bands_joins_and_prefixes(spark):
    df = spark.createDataFrame([(1, 5.0, 9.0, "Pa"), (1, 9.1, 12.0, "pa"), (1, 20.0, 24.0, "2.5"), (1, 22.0, 23.0, "9"), (2, 20.0, 21.0, "3")], "r int, x0 double, x1 double, t string")
    got = {x.r: (x.nombre, x.precio) for x in in_bands(df, ["r"], "x0", "t", {"nombre": (0, 19), "precio": (19, 30)}).collect()}
    assert got == {1: ("Pa", "2.5"), 2: (None, "3")}
    assert {x.r: x.texto for x in joined(df, ["r"], "x0", "x1", "t").collect()} == {1: "Papa 2.59", 2: "3"}
    texts = spark.createDataFrame([("MERCADO UNO PAPA",), ("MERCADO UNO NORTE YUCA",), ("OTRO AJO",), (None,)], "t string")
    known = spark.createDataFrame([("MERCADO UNO",), ("MERCADO UNO NORTE",)], "p string")
    out = {r.t: (r.prefijo, r.resto) for r in longest_prefix(texts, "t", known, "p").collect()}
    assert out == {"MERCADO UNO PAPA": ("MERCADO UNO", "PAPA"), "MERCADO UNO NORTE YUCA": ("MERCADO UNO NORTE", "YUCA"), "OTRO AJO": (None, "OTRO AJO"), None: (None, None)}
    number, letters = split_letters("t")
    r = spark.createDataFrame([("2.50Estable",), ("E2s.t5able",)], "t string").select(number.alias("n"), letters.alias("l")).collect()
    assert [(x.n, x.l) for x in r] == [(2.5, "Estable"), (2.5, "Estable")]


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "Precio", 50.0), (1, "PRODUCTO", 1.0), (1, "producto", 90.0), (1, "otro", 5.0), (2, "otro", 1.0)], "d int, t string, x double")
    got = {r.d: (r.huella, r.faltan) for r in fingerprint(df, ["d"], "t", "x", ["producto", "precio", "masa"]).collect()}
    assert got == {1: ("producto|precio", ["masa"]), 2: ("", ["producto", "precio", "masa"])}


def test_split_against_all_thresholds():
    rng = np.random.default_rng(0)
    x, r = rng.integers(0, 5, (30, 3)).astype(float), rng.normal(size=30)
    rows = rng.random(30) < 0.8
    i, cut = best_split(np.argsort(x, axis=0, kind="stable"), x, r, rows)

    def error(k, c):
        parts = [r[rows & (x[:, k] <= c)], r[rows & (x[:, k] > c)]]
        return sum(((p - p.mean()) ** 2).sum() for p in parts if len(p)) if all(len(p) for p in parts) else np.inf

    assert np.isclose(error(i, cut), min(error(k, c) for k in range(3) for c in np.arange(0.5, 4)))
    assert best_split(np.zeros((3, 1), int), np.ones((3, 1)), r[:3], np.ones(3, bool)) is None


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (400, 2))
    y = np.where(x[:, 0] > 0, np.where(x[:, 1] > 0, 3.0, 1.0), 0.0)
    for new, want in (((0.5, 0.5), 3), ((0.5, -0.5), 1), ((-0.5, 0.5), 0)):
        assert abs(boosted(x, y, np.array(new)) - want) < 0.1


def test_fits_side_by_side_are_those_one_by_one():
    rng = np.random.default_rng(2)
    wide, few = rng.normal(size=(150, 1)), rng.integers(0, 9, (150, 1)).astype(float)
    for x, new in ((wide, rng.normal(size=(20, 1))), (few, rng.integers(-1, 11, (20, 1)).astype(float))):
        y = np.sin(2 * x[:, 0]) + rng.normal(size=150)
        ends = np.arange(31, 150, 6)
        got = boosted_each(x, y, ends, new)
        assert np.allclose(got, [boosted(x[:e], y[:e], v) for e, v in zip(ends, new)], rtol=1e-9)
    y = np.where(wide[:, 0] > 0, np.where(few[:, 0] > 3, 3.0, 1.0), 0.0)
    got = boosted_each(np.hstack([wide, few]), y, np.array([150, 150, 150]), np.array([[0.9, 8], [0.9, 0], [-0.9, 8]]))
    assert np.allclose(got, [3, 1, 0], atol=0.1)
    # Where several features set a spike apart equally well, the first of them does.
    x = np.hstack([np.round(wide, 1), few, np.arange(150.0)[:, None]])
    y = np.where(np.arange(150) % 40 == 7, 1e6, y)
    new = np.hstack([rng.normal(size=(20, 1)), rng.integers(0, 9, (20, 1)), rng.integers(0, 200, (20, 1))])
    assert np.allclose(boosted_each(x, y, ends, new), [boosted(x[:e], y[:e], v) for e, v in zip(ends, new)], rtol=1e-9)
    # Neither a constant value nor a constant feature can be split.
    assert np.allclose(boosted_each(wide, np.full(150, 7.0), np.array([40, 150]), new[:2]), 7)
    assert np.allclose(boosted_each(np.ones((150, 1)), y, np.array([40, 150]), new[:2]), [y[:40].mean(), y.mean()])


def test_features_look_back_only():
    y, day = np.arange(20.0), np.arange(19800, 19820)
    off = np.array([19805, 19850])
    for ahead in (1, 7):
        x = features(y, day, ahead, off)
        assert x[19, 0] == y[19 - ahead] and x[19, 4] == y[max(0, 19 - 6 - ahead)] and np.isnan(x[ahead - 1, 0])
    assert x[5, -2] == 1 and x[4, -1] == 1 and x[6, -1] == 30
    assert origins(59, 70, 1, 60) == list(range(59, 69)) and len(origins(59, 500, 1, 60)) == 60


def test_refitted_models(spark):
    rng = random.Random(0)
    rows, v = [], 1000
    for i in range(150):
        m = rng.randint(50, 150)
        rows.append((1, 1, dt.date(2024, 1, 1) + dt.timedelta(i), int(v), None if i % 7 == 0 else m))
        v = 1000 + 0.5 * (v - 1000) + 3 * (m - 100)
    rows += [(2, 1, dt.date(2024, 1, 1) + dt.timedelta(i), 5, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha date, p bigint, m bigint")
    got = {(r.producto_id, r.metodo): r for r in refitted(df, "p", "m", most=10).collect()}
    assert set(got) == {(1, "gbm"), (1, "ar1"), (1, "ar1_volumen")} and all(r.origenes == 10 for r in got.values())
    assert got[1, "ar1_volumen"].mae < got[1, "ar1"].mae


def test_each_model_has_its_own_thresholds(spark):
    rng = random.Random(1)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    rows = [(k, 1, day(i), rng.randint(900, 1100), rng.randint(50, 150) if k != 4 or i < 89 else None) for k, n in ((1, 130), (2, 100), (3, 89), (4, 110)) for i in range(n)]
    df = spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha date, p bigint, m bigint")
    got = {(r.producto_id, r.metodo): r for r in refitted(df, "p", "m", most=1000, rows=60).collect()}
    assert set(got) == {(1, "gbm"), (1, "ar1"), (1, "ar1_volumen"), (2, "ar1"), (2, "ar1_volumen"), (4, "ar1")}
    # The regressions begin at place 29; gbm where 60 rows have all lags, which is place 66.
    assert got[2, "ar1"].origenes == got[2, "ar1_volumen"].origenes == 70
    assert got[1, "ar1"].origenes == 100 and got[1, "gbm"].origenes == 63
    y = np.array([r[3] for r in rows if r[0] == 2], float)
    fit = lambda t: np.linalg.lstsq(np.c_[y[:t], np.ones(t)], y[1 : t + 1], rcond=None)[0]
    assert np.isclose(got[2, "ar1"].mae, np.mean([abs(fit(t) @ [y[t], 1] - y[t + 1]) for t in range(29, 99)]))
