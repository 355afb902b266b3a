"""Implausible readings of a series: bounds, short departures from the level, frozen values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Marks that `implausible` gives.
FINE, BOUND, SPIKE, FROZEN = 0, 1, 2, 3


@dataclass(frozen=True)
class Rules:
    """low, high: physical bounds (exclusive). half: readings on each side of the rolling median.
    sigmas: rolling MADs that a spike lies from the rolling median. moves: usual moves of the series
    (1.4826 times its median absolute step) by which a spike leaves both neighbours. least: the smallest such log
    departure, which rules for series that hardly move. longest: readings of a spike at most.
    frozen: readings of one value that make a run. repeats: share of repeated readings from which
    a series is one that moves in steps, in which runs are normal."""

    low: float = 0.0
    high: float = 200.0
    half: int = 6
    sigmas: float = 3.0
    moves: float = 4.5
    least: float = 0.28
    longest: int = 3
    frozen: int = 10
    repeats: float = 0.5


def rolling_median(v: np.ndarray, series: np.ndarray, half: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Median of the readings within `half` places in the same series; skipped ones don't count."""
    n = len(v)
    at = np.arange(n)[:, None] + np.arange(-half, half + 1)[None, :]
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    use = inside & (series[at] == series[:, None])
    if skip is not None:
        use &= ~skip[at]
    w = np.where(use, v[at], np.inf)
    w.sort(axis=1)
    count = use.sum(1)
    row = np.arange(n)
    lo, hi = np.maximum((count - 1) // 2, 0), np.maximum(count // 2, 0)
    return np.where(count > 0, (w[row, lo] + w[row, hi]) / 2, np.nan)


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run, where same[i] says that i belongs to the run of i - 1."""
    start = np.flatnonzero(~same)
    return start, np.diff(np.append(start, len(same)))


def departures(y: np.ndarray, series: np.ndarray, longest: int, apart: float = np.inf) -> np.ndarray:
    """How far each reading lies beyond both neighbours, as a member of the best window of at most
    `longest` readings: the least distance of the window's members from the reading before it and
    the reading after it, all on one side; 0 if there is no such window. Negative below them. Only windows whose two neighbours differ by less
    than `apart` times that distance."""
    best = np.zeros(len(y))
    for size in range(1, longest + 1):
        i = np.arange(1, len(y) - size)
        i = i[series[i - 1] == series[i + size]]
        if not len(i):
            continue
        window = y[i[:, None] + np.arange(size)]
        before, after = y[i - 1], y[i + size]
        above = window.min(1) - np.maximum(before, after)
        below = np.minimum(before, after) - window.max(1)
        far = np.maximum(np.maximum(above, below), 0)
        if np.isfinite(apart):
            far[np.abs(after - before) >= apart * far] = 0
        signed = np.where(above > below, far, -far)
        for k in range(size):
            best[i + k] = np.where(far > np.abs(best[i + k]), signed, best[i + k])
    return best


def strongest(away: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Of departures side by side on different sides, only those on the side of the largest."""
    is_one = away != 0
    joined = np.r_[False, is_one[1:] & is_one[:-1] & (series[1:] == series[:-1])]
    start, length = runs(joined)
    if not len(start):
        return away
    side = np.where(np.maximum.reduceat(away, start) >= -np.minimum.reduceat(away, start), 1, -1)
    return np.where(np.sign(away) == np.repeat(side, length), away, 0)


def implausible(value: np.ndarray, series: np.ndarray, rules: Rules = Rules()) -> np.ndarray:
    """The mark of each reading. NaN is no reading: it is skipped in counting and never marked.

    A Hampel filter on logarithms. Up to `longest` readings in a row are a spike if all of them lie
    on one side of both the reading before and the reading after, by more than the series moves
    (`moves`, `least`), and away from the rolling median by `sigmas` rolling MADs, candidates not
    counted. A lasting change of level leaves one of the neighbours only. A spike needs readings on
    both sides. Readings beyond the bounds don't count as neighbours or level. In a series in which
    fewer than `repeats` of the readings repeat the one before, runs of at least `frozen` equal
    readings are frozen: all but their first. Where several hold: bound, spike, frozen.
    """
    mark = np.zeros(len(value), np.int8)
    real = np.flatnonzero(~np.isnan(value))
    v, s = value[real], series[real]
    if not len(v):
        return mark
    got = np.zeros(len(v), np.int8)
    first = np.r_[True, s[1:] != s[:-1]]
    code = np.cumsum(first) - 1
    same = np.r_[False, np.isclose(v[1:], v[:-1], rtol=1e-6, atol=0)] & ~first
    share = np.bincount(code, same) / np.bincount(code)
    start, length = runs(same)
    long = (length >= rules.frozen) & (share[code[start]] < rules.repeats)
    got[np.repeat(long, length) & same] = FROZEN

    bad = (v <= rules.low) | (v >= rules.high)
    keep = np.flatnonzero(~bad)
    if len(keep):
        y, c = np.log(v[keep]), code[keep]
        step = np.r_[np.nan, np.diff(y)]
        step[np.r_[True, c[1:] != c[:-1]]] = np.nan
        moved = ~np.isnan(step)
        usual = np.zeros(code[-1] + 1)
        held = _median_of(np.abs(step[moved]), c[moved]) * 1.4826
        usual[: len(held)] = held
        bar = np.maximum(rules.moves * usual, rules.least)[c]
        # Plain spikes first: they return to the level they left. Then those at a change of level,
        # among the readings that are left, so that no reading is judged by a spike beside it.
        away = departures(y, c, rules.longest, 0.5)
        away = np.abs(strongest(np.where(np.abs(away) > bar, away, 0), c))
        rest = np.flatnonzero(away == 0)
        away[rest] = np.abs(departures(y[rest], c[rest], rules.longest))
        centre = rolling_median(y, c, rules.half, skip=away > bar)
        off = np.abs(y - centre)
        near = rolling_median(off, c, rules.half, skip=away > bar) * 1.4826
        spike = (away > bar) & (off > np.maximum(rules.sigmas * np.nan_to_num(near), 0.6 * bar))
        got[keep[spike]] = SPIKE
    got[bad] = BOUND
    mark[real] = got
    return mark


def _median_of(v: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Median by code; 0 for codes without values."""
    n = np.bincount(code)
    at = np.lexsort((v, code))
    start = np.cumsum(n) - n
    out = np.zeros(len(n))
    has = n > 0
    out[has] = (v[at[(start + (n - 1) // 2)[has]]] + v[at[(start + n // 2)[has]]]) / 2
    return out
