import itertools
import math

import numpy as np
import pytest

from lonja.operators.units import ScaleModel, measure_of, viterbi, with_unit

CASES = [
    ("Saco x 60 Kg.", 60, "Kilogramo", False),
    ("CAJA DE 18,5KG", 18.5, "Kilogramo", False),
    ("caja c/9.5kg", 9.5, "Kilogramo", False),
    ("Saco (100 kilogramos)", 100, "Kilogramo", False),
    ("Bolsa 250 gr.", 250, "Gramo", False),
    ("100 g", 100, "Gramo", False),
    ("Saco 110lb.", 110, "Libra", False),
    ("Bolsa x 22 libras", 22, "Libra", False),
    ("kilogramo ", None, "Kilogramo", False),
    ("Kg - céntimos", None, "Kilogramo", True),
    ("kilo en centimos", None, "Kilogramo", True),
    ("kg cts", None, "Kilogramo", True),
    ("LB.", None, "Libra", False),
    ("@", None, "Arroba", False),
    ("arrob.", None, "Arroba", False),
    ("QQ.", None, "Quintal", False),
    ("TM", None, "Tonelada", False),
    ("tn", None, "Tonelada", False),
    ("por cajón", None, None, False),
    ("Ciento ", None, None, False),
    ("por ciento", None, None, False),
    ("Atados", None, None, False),
    ("", None, None, False),
    (None, None, None, False),
]


def test_texts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    number, named, hundredths = measure_of("t")
    for r in df.select("i", number.alias("n"), named.alias("m"), hundredths.alias("h")).collect():
        assert (r.n, r.m, r.h) == CASES[r.i][1:], CASES[r.i]


def test_units_in_order_of_precedence(spark):
    rows = spark.createDataFrame([(1, "Saco 25lb."), (1, "qq"), (1, "Jaba"), (2, "Jaba"), (None, None), (1, "kg")], "producto_id int, unidad string")
    measures = spark.createDataFrame([("Libra", 0.4536), ("Quintal", 46.0), ("Kilogramo", 1.0)], "unidad string, equiv_kg double")
    products = spark.createDataFrame([(1, 17.0), (2, None), (None, 3.0)], "id int, equiv_kg double")
    got = [r["_kg"] for r in with_unit(rows, measures, products).collect()]
    assert sorted(x for x in got if x is not None) == sorted([25 * 0.4536, 46.0, 17.0, 1.0]) and got.count(None) == 2


def brute(y, anchor, model):
    """Least cost over all paths, for one short series without gaps."""
    off, best = np.array(model.offsets), None
    for path in itertools.product(range(len(off)), repeat=len(y)):
        s = 0.0 if path[0] == 0 else model.start
        for t in range(len(y)):
            s += model.density(np.array(y[t] - off[path[t]] - anchor), model.level)
            if t:
                s += model.density(np.array(y[t] - y[t - 1] - off[path[t]] + off[path[t - 1]]), model.step)
                s += model.switch if path[t] != path[t - 1] else 0.0
        if best is None or s > best[0]:
            best = (s, path)
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_path(seed):
    rng = np.random.default_rng(seed)
    model = ScaleModel(switch=-6.0)
    y = 1 + np.cumsum(rng.normal(0, 0.1, 9))
    y[3 : 3 + seed] += np.log(100)
    got = viterbi(y, np.full(9, 1.0), np.zeros(9, bool), np.zeros(9, int), model)
    assert tuple(got) == brute(y, 1.0, model)


def test_a_switch_lasts_and_a_spike_does_not():
    y = np.full(60, 1.0)
    y[10:12] += np.log(100)
    y[30:45] += np.log(100)
    y[35] = np.nan
    series = np.zeros(60, int)
    state = viterbi(y, np.full(60, 1.0), np.zeros(60, bool), series, ScaleModel())
    assert np.flatnonzero(state).tolist() == list(range(30, 45))
    marked = np.ones(60, bool)
    assert not viterbi(y, np.full(60, 1.0), marked, series, ScaleModel()).any()
    whole = viterbi(np.full(40, 1 + np.log(100)), np.full(40, 1.0), np.zeros(40, bool), np.zeros(40, int), ScaleModel())
    assert whole.all()


def test_series_are_apart_and_empty_is_fine():
    y = np.r_[np.full(20, 1.0), np.full(30, 1 + np.log(100))]
    series = np.repeat([0, 1], [20, 30])
    anchor = np.r_[np.full(20, 1.0), np.full(30, 1 + np.log(100))]
    assert not viterbi(y, anchor, np.zeros(50, bool), series, ScaleModel()).any()
    assert len(viterbi(np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros(0, int), ScaleModel())) == 0
    assert viterbi(np.full(3, np.nan), np.full(3, np.nan), np.zeros(3, bool), np.zeros(3, int), ScaleModel()).tolist() == [0, 0, 0]


def test_units_of_silent_rows_are_decoded_from_the_values():
    rng = np.random.default_rng(4)
    n, model = 40, ScaleModel(units=(0.4536, 1.0, 46.0))
    level = math.log(3.0) + np.cumsum(rng.normal(0, 0.03, n))
    kg = np.full(n, 20.0)  # the product's container, which a silent row is taken for
    true = np.full(n, 20.0)
    true[10:16], true[20], true[25:30] = 1.0, 46.0, 20.0
    silent = np.zeros(n, bool)
    silent[10:16], silent[20], silent[25:30] = True, True, True
    hundred = np.zeros(n, bool)
    hundred[12:16] = True
    published = np.exp(level) * true * np.where(hundred, 100, 1)
    y = np.log(published / kg)
    state = viterbi(y, np.full(n, level.mean()), np.zeros(n, bool), np.zeros(n, int), model, silent, kg)
    unit = np.where(state // 2 > 0, np.array([0, *model.units])[state // 2], kg)
    assert unit.tolist() == true.tolist() and (state % 2 == 1).tolist() == hundred.tolist()
    # Where the text speaks, it holds, however odd the values are.
    spoken = viterbi(y, np.full(n, level.mean()), np.zeros(n, bool), np.zeros(n, int), model, np.zeros(n, bool), kg)
    assert set(spoken) <= {0, 1}
