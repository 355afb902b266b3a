import numpy as np

from lonja.operators.spikes import BOUND, FINE, FROZEN, SPIKE, departures, implausible, rolling_median


def walk(n=80, seed=0, level=3.0):
    return level * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))


def marks(v, series=None):
    v = np.asarray(v, float)
    return implausible(v, np.zeros(len(v), int) if series is None else series)


def test_rolling_median_against_brute_force():
    rng = np.random.default_rng(0)
    v, s = rng.normal(size=60), np.repeat([0, 1, 2], [5, 40, 15])
    skip = rng.random(60) < 0.2
    got = rolling_median(v, s, 4, skip)
    for i in range(60):
        near = [v[j] for j in range(max(0, i - 4), min(60, i + 5)) if s[j] == s[i] and not skip[j]]
        assert (np.isnan(got[i]) and not near) or np.isclose(got[i], np.median(near))


def test_spikes_of_up_to_three_readings():
    for size in (1, 2, 3):
        for factor in (1.6, 10, 0.5):
            v = walk()
            v[40 : 40 + size] *= factor
            assert np.flatnonzero(marks(v) == SPIKE).tolist() == list(range(40, 40 + size))


def test_a_lasting_change_is_no_spike():
    v = walk()
    v[40:] *= 2.5
    assert not marks(v).any()
    v = walk()
    v[40:44] *= 2.5
    assert not marks(v).any()


def test_edges_need_readings_on_both_sides():
    for at in (0, -1):
        v = walk()
        v[at] *= 5
        assert not marks(v).any()


def test_bounds_and_gaps():
    v = walk()
    v[[10, 20, 30]] = [0, -3, 9999]
    v[[5, 11]] = np.nan
    m = marks(v)
    assert np.flatnonzero(m).tolist() == [10, 20, 30] and set(m[[10, 20, 30]]) == {BOUND}


def test_frozen_runs_skip_missing_readings():
    v = walk()
    v[20:32] = v[20]
    v[25] = np.nan
    m = marks(v)
    assert np.flatnonzero(m == FROZEN).tolist() == [i for i in range(21, 32) if i != 25]
    v[20:29], v[29:32] = 3.0, walk()[29:32]
    assert not (marks(v) == FROZEN).any()


def test_series_that_move_in_steps():
    v = np.repeat([3.0, 3.5, 3.2, 4.0], 20)
    assert not marks(v).any()
    v[30] = 9.0
    assert np.flatnonzero(marks(v)).tolist() == [30]


def test_series_do_not_mix():
    v = np.r_[walk(level=2), walk(level=20)]
    assert not marks(v, np.repeat([0, 1], 80)).any()
    assert marks(np.array([])).tolist() == [] and marks([np.nan, np.nan]).tolist() == [FINE, FINE]


def test_departures_are_signed():
    y = np.array([0, 0, 1, 1, 0, -2, 0.0])
    assert departures(y, np.zeros(7, int), 3).tolist() == [0, 0, 1, 1, 0, -2, 0]
