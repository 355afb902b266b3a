from pathlib import Path

import numpy as np

from lonja.operators import boosting
from lonja.operators.boosting import answered, answers, boosted, message
from lonja.session import java_function


def cases():
    rng = np.random.default_rng(4)
    n, ends = 150, np.arange(31, 150, 6)
    wide, few = rng.normal(size=(n, 2)), rng.integers(0, 9, (n, 2)).astype(float)
    x = np.hstack([np.round(wide, 1), few])
    y = np.sin(2 * wide[:, 0]) + rng.normal(size=n)
    new = np.hstack([rng.normal(size=(20, 2)), rng.integers(-1, 11, (20, 2))])
    yield x, y, ends, new
    yield x[:, :1], y, ends[::-1], new[:, :1]  # in any order
    yield x, np.where(np.arange(n) % 40 == 7, 1e6, y), ends, new  # several features set a spike apart
    yield x, np.full(n, 7.0), ends[:3], new[:3]  # nothing to learn
    yield np.ones((n, 4)), y, ends[:9], new[:9]  # nothing to part by
    yield x, y, np.array([1, 2, 3, 150]), new[:4]
    yield np.c_[np.arange(n) > 75, few], np.where(np.arange(n) > 75, 5.0, -5.0), ends, new[:, :3]  # one cut tells all


def test_the_jvm_fits_as_numpy_does(spark):
    made = list(cases())
    rows = [(i, bytearray(message(*c))) for i, c in enumerate(made)] + [(len(made), None)]
    got = {r.i: r.a for r in spark.createDataFrame(rows, "i int, m binary").select("i", answers(spark, "m").alias("a")).collect()}
    assert got.pop(len(made)) is None
    for i, (x, y, ends, new) in enumerate(made):
        want = [boosted(x[:e], y[:e], v) for e, v in zip(ends, new)]
        assert np.allclose(got[i], want, rtol=1e-9) and np.allclose(answered(message(x, y, ends, new)), want, rtol=1e-9)


def test_cuts_are_found_in_the_sums_as_they_run(spark):
    rng = np.random.default_rng(6)
    n, ends = 150, np.arange(31, 150, 6)
    wide, few = rng.normal(size=(n, 2)), rng.integers(0, 9, (n, 2)).astype(float)
    new = np.hstack([rng.normal(size=(20, 2)), rng.integers(-1, 11, (20, 2))])
    y = np.sin(2 * wide[:, 0]) + rng.normal(size=n)
    long, late = np.c_[np.arange(700.0) % 97, rng.normal(size=700)], np.array([1, 2, 15, 16, 17, 33, 699, 700])  # ends of blocks
    made = [
        (np.c_[few[:, 0], wide[:, 0], few[:, 1], wide[:, 1]], y, ends, new[:, [2, 0, 3, 1]]),
        (np.c_[wide[:, 0], wide[:, 0], -wide[:, 0]], y, ends, new[:, [0, 0, 1]]),  # equal cuts
        (np.hstack([np.round(wide, 1), few]), np.where(wide[:, 0] < 0, 1e9, 0.0) + y, ends, new),  # one node hides the other's errors
        (few[:4, :1], np.array([1e8, -1e8, 1.0, -1.0]), np.array([2, 3, 4]), new[:3, 2:3]),
        (long, rng.normal(size=700), late, rng.normal(size=(8, 2))),
    ]
    rows = [(i, bytearray(message(*c))) for i, c in enumerate(made)]
    got = {r.i: r.a for r in spark.createDataFrame(rows, "i int, m binary").select("i", answers(spark, "m").alias("a")).collect()}
    for i, (x, y, ends, new) in enumerate(made):
        assert np.allclose(got[i], [boosted(x[:e], y[:e], v) for e, v in zip(ends, new)], rtol=1e-9, atol=1e-14 * abs(y).max())


def test_trees_grow_in_the_jvm(spark):
    assert java_function(spark, "lonja_boosted", "lonja.Boosting", Path(boosting.__file__).with_name("Boosting.java"), "array<double>")


def test_without_the_vector_module_numpy_fits(spark, tmp_path, monkeypatch):
    lost = tmp_path / "Lost.java"
    lost.write_text("package lonja; import lost.Module; public class Lost {}")
    assert not java_function(spark, "lost", "lonja.Lost", lost, "array<double>")
    monkeypatch.setattr(boosting, "java_function", lambda *a: False)
    x, y, ends, new = next(cases())
    df = spark.createDataFrame([(bytearray(message(x, y, ends, new)),), (None,)], "m binary")
    got = [r.a for r in df.select(answers(spark, "m").alias("a")).collect()]
    assert np.allclose(got[0], [boosted(x[:e], y[:e], v) for e, v in zip(ends, new)], rtol=1e-9) and got[1] is None


def test_regressions_from_sums_are_those_of_the_rows():
    rng = np.random.default_rng(5)
    walk = 50_000 + rng.integers(-900, 900, 200).cumsum().astype(float)
    mass = rng.integers(0, 9000, 200).astype(float)
    late = np.where(np.arange(200) < 60, 7.0, walk)  # nothing to fit by at first
    for y, m in ((walk, mass), (walk, None), (late, mass), (late, None), (walk, 3 * walk), (walk, np.full(200, 5.0)), (walk / 7 + 1e6, mass / 3), (np.full(200, 3.0), None)):
        for ahead in (1, 7):
            ts = np.arange(29, 200)
            want = []
            for t in ts:
                cols = [v[: t + 1 - ahead] for v in (y, m) if v is not None]
                w = np.linalg.lstsq(np.stack([*cols, np.ones(t + 1 - ahead)], 1), y[ahead : t + 1], rcond=None)[0]
                want.append(np.dot(w, [*(v[t] for v in (y, m) if v is not None), 1.0]))
            assert np.allclose(boosting.regressed(y, m, ts, ahead), want, rtol=1e-8)
