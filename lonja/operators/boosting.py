"""Walk-forward errors of models without closed window form: boosted trees, and regression on volume."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.calendar import holidays
from lonja.operators.series import SERIES, Block, map_series
from lonja.session import java_function

#: Lags of the boosted trees.
LAGS = (1, 2, 3, 5, 7)
#: How many origins are fitted side by side: as many as a core's cache holds sums of.
SIDE = 20
#: Cuts that lower the error by so much of what the best does are its equals: they part the rows alike but for rounding.
EQUAL = 1 - 1e-9
#: Of each model: the fewest values of a series, and the place of its first origin.
LEAST = {"estacional": 90, "tendencia": 90, "gbm": 120, "ar1": 90, "ar1_volumen": 90}
FIRST = {"estacional": 29, "tendencia": 29, "gbm": 60, "ar1": 29, "ar1_volumen": 29}


def best_split(order: np.ndarray, x: np.ndarray, r: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """(feature, threshold) that lowers the squared error of r over the given rows most, the first of equals; None if there is none.

    order: rows by each feature's value (n, f); rows: mask of those that take part.
    """
    n, f = int(rows.sum()), x.shape[1]
    if n < 2:
        return None
    at = order.T[rows[order.T]].reshape(f, n)
    v = np.take_along_axis(x.T, at, 1)
    s = np.cumsum(r[at], axis=1)
    left = np.arange(1, n)
    total = s[:, -1:]
    gain = (s[:, :-1] - total * (left / n)) ** 2 / (left * (n - left))
    gain[v[:, 1:] == v[:, :-1]] = -np.inf
    most = gain.max()
    if not np.isfinite(most):
        return None
    i, j = divmod(int(np.argmax(gain >= most * EQUAL)), n - 1)
    return i, (v[i, j] + v[i, j + 1]) / 2


def boosted(x: np.ndarray, y: np.ndarray, new: np.ndarray, trees: int = 120, rate: float = 0.05) -> float:
    """Prediction at `new` of boosted regression trees of depth two, fitted to all rows of (x, y)."""
    order = np.argsort(x, axis=0, kind="stable")
    out = float(y.mean())
    r = y - out
    every = np.ones(len(y), bool)
    for _ in range(trees):
        root = best_split(order, x, r, every)
        if root is None:
            break
        step = np.zeros(len(y))
        ahead = 0.0
        low = x[:, root[0]] <= root[1]
        for side, holds in ((low, new[root[0]] <= root[1]), (~low, new[root[0]] > root[1])):
            leaf = best_split(order, x, r, side)
            if leaf is None:
                parts = [(side, True)]
            else:
                below = x[:, leaf[0]] <= leaf[1]
                parts = [(side & below, new[leaf[0]] <= leaf[1]), (side & ~below, new[leaf[0]] > leaf[1])]
            for rows, within in parts:
                mean = float(r[rows].mean())
                step[rows] = mean
                if holds and within:
                    ahead = mean
        r = r - rate * step
        out += rate * ahead
    return out


class Sums:
    """Of sets of weights of the rows of x: the sums of each set over the rows whose value is at most each of
    x's distinct values, for all features side by side (a column for each value of each feature).

    Features of many values, and those before them, are added up along their rows in order, in blocks; the others by a product of matrices.
    """

    BLOCK, FEW = 16, 40

    def __init__(self, x: np.ndarray):
        n, f = x.shape
        parts = [np.unique(c, return_inverse=True) for c in x.T]
        many = max((i + 1 for i in range(f) if len(parts[i][0]) > self.FEW), default=0)
        first = np.append(0, np.cumsum([len(p[0]) for p in parts]))
        #: Of each column its feature and value; of each feature its first column and the one after its last.
        self.feature, self.value = np.repeat(np.arange(f), np.diff(first)), np.concatenate([p[0] for p in parts])
        self.first, self.last = first[:-1], first[1:]
        self.rank, self.place = np.stack([p[1] for p in parts]), np.concatenate([np.arange(len(p[0])) for p in parts])
        self.split = int(first[many])
        self.few = np.ascontiguousarray(self.rows(np.arange(self.split, first[-1])).T)
        # Row j of block k of a feature's sorted rows stands at j, feature, k; n is a row of zeros.
        blocks = -(-n // self.BLOCK)
        at = np.full((many, blocks * self.BLOCK), n)
        ends = [np.empty(0, int)]
        for i in range(many):
            at[i, :n] = np.argsort(parts[i][1], kind="stable")
            k, rest = np.divmod(np.cumsum(np.bincount(parts[i][1])) - 1, self.BLOCK)
            ends.append((rest * many + i) * blocks + k)
        self.at = at.reshape(many, blocks, self.BLOCK).transpose(2, 0, 1).ravel()
        self.ends, self.shape = np.concatenate(ends), (many, blocks)

    def rows(self, k: np.ndarray) -> np.ndarray:
        """Of each of the columns which rows it sums: 1 or 0."""
        return (self.rank.take(self.feature[k], 0) <= self.place[k][:, None]).astype(float)

    def __call__(self, a: np.ndarray) -> np.ndarray:
        """a: sets, rows; sets, columns."""
        sets, n = a.shape
        out = np.empty((sets, len(self.value)))
        if self.split:
            rows = np.zeros((n + 1, sets))
            rows[:n] = a.T
            g = rows.take(self.at, 0, mode="clip").reshape(self.BLOCK, -1, sets)
            for j in range(1, self.BLOCK):
                np.add(g[j], g[j - 1], out=g[j])
            before = np.zeros((*self.shape, sets))
            np.cumsum(g[-1].reshape(*self.shape, sets)[:, :-1], axis=1, out=before[:, 1:])
            s = g.reshape(-1, sets).take(self.ends, 0)
            s += before.reshape(-1, sets).take(self.ends % (self.shape[0] * self.shape[1]), 0)
            out[:, : self.split] = s.T
        np.matmul(a, self.few, out=out[:, self.split :])
        return out


def _cut(s: np.ndarray, total: np.ndarray, count: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set's node the column that lowers the squared error most, the first of equals, and whether any does part its rows.

    s, count: sums and numbers of rows by column; total, n: those of the node; weight: 1 / (count * (n - count)).
    """
    gain = count * (total / np.maximum(n, 1))[:, None]
    np.subtract(s, gain, out=gain)
    gain *= gain
    gain *= weight
    k, row = (gain >= gain.max(1, keepdims=True) * EQUAL).argmax(1), np.arange(len(s))
    parts = lambda k: (count[row, k] > 0) & (count[row, k] < n)
    if not parts(k).all():  # where nothing is gained, rounding may have chosen a column that parts nothing
        some = np.flatnonzero(~parts(k))
        k[some] = np.where((count[some] > 0) & (count[some] < n[some, None]), gain[some], -1).argmax(1)
    return k, parts(k)


def _weight(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 / (count * (n - count)); any number where that is 0."""
    w = n[:, None] - count
    w *= count
    np.maximum(w, 0.5, out=w)
    return np.divide(1, w, out=w)


def boosted_each(x: np.ndarray, y: np.ndarray, ends: np.ndarray, new: np.ndarray, trees: int = 120, rate: float = 0.05) -> np.ndarray:
    """For each o what `boosted` predicts at new[o], fitted to the first ends[o] rows of (x, y); all are fitted side by side."""
    n, sets = int(ends.max()), len(ends)
    x, y = x[:n], y[:n]
    sums, row = Sums(x), np.arange(sets)
    part = (np.arange(n) < ends[:, None]).astype(float)
    out = y.cumsum()[ends - 1] / ends
    r = (y - out[:, None]) * part
    count = sums(part)
    weight = _weight(count, ends)
    # Of each new row and feature the last column whose value is not beyond it; -1 without any.
    near = np.stack([a + np.searchsorted(sums.value[a:b], new[:, i], "right") - 1 for i, (a, b) in enumerate(zip(sums.first, sums.last))], 1)
    near = np.where(near >= sums.first, near, -1)

    def below(held: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether each new row lies below its cut, half way to the next value that the node has."""
        f = sums.feature[k]
        at = near[row, f]
        here, cut = np.where(at >= 0, held[row, at], 0), held[row, k]
        low = here < cut
        for o in np.flatnonzero(here == cut):
            own, values = held[o, (at := slice(sums.first[f[o]], sums.last[f[o]]))], sums.value[at]
            after = min(int(own.searchsorted(cut[o], "right")), len(own) - 1)
            low[o] = new[o, f[o]] <= (values[own.searchsorted(cut[o])] + values[after]) / 2
        return low

    # Numbers of rows below a root's cut by column, for the roots that the sets had last; few roots take turns.
    kept = np.empty((max(2 * sets, min(trees * sets, 16_000_000 // len(sums.value))), len(sums.value)), np.int32)
    known: dict[tuple[int, int], int] = {}
    alive = np.ones(sets, bool)
    for _ in range(trees):
        s, total = sums(r), r.sum(1)
        root, there = _cut(s, total, count, ends, weight)
        alive &= there
        if not alive.any():
            break
        left = sums.rows(root)
        pairs = list(zip(range(sets), root.tolist()))
        fresh = [o for o, p in enumerate(pairs) if p not in known]
        if len(known) + len(fresh) > len(kept):
            known.clear()
            fresh = list(range(sets))
        if fresh:
            kept[len(known) : len(known) + len(fresh)] = sums(left[fresh] * part[fresh])
            known.update({pairs[o]: len(known) + i for i, o in enumerate(fresh)})
        low = kept.take([known[p] for p in pairs], 0).astype(float)
        low_n, low_total = count[row, root], s[row, root]
        low_s = sums(r * left)
        s -= low_s
        nodes = []
        for held, all_s, c, all_n in ((low_s, low_total, low, low_n), (s, total - low_total, count - low, ends - low_n)):
            k, cuts = _cut(held, all_s, c, all_n, _weight(c, all_n))
            inside, within, mean = held[row, k], c[row, k], all_s / np.maximum(all_n, 1)
            here = np.where(cuts, inside / np.maximum(within, 1), mean)
            beyond = np.where(cuts, (all_s - inside) / np.maximum(all_n - within, 1), mean)
            nodes.append((k, here * alive, beyond * alive, below(c, k)))
        (k, a, b, under), (j, c, d, over) = nodes
        out += rate * np.where(below(count, root), np.where(under, a, b), np.where(over, c, d))
        # A row's step: a or b on the left, c or d on the right.
        step = sums.rows(k)
        step *= (a - b)[:, None]
        step += b[:, None]
        other = sums.rows(j)
        other *= (c - d)[:, None]
        other += d[:, None]
        step -= other
        step *= left
        step += other
        step *= part
        step *= rate
        r -= step
    return out


def message(x: np.ndarray, y: np.ndarray, ends: np.ndarray, new: np.ndarray, trees: int = 120, rate: float = 0.05) -> bytes:
    """What `boosted_each` takes, as Boosting.java reads it."""
    n = int(ends.max())
    x, y = x[:n], y[:n]
    order = np.argsort(x.T, axis=1, kind="stable")
    parts = ((x.T, "<f8"), (y, "<f8"), (new, "<f8"), (ends, "<i4"), (order, "<i4"))
    return struct.pack("<4id", n, x.shape[1], len(ends), trees, rate) + b"".join(np.ascontiguousarray(a, t).tobytes() for a, t in parts)


def answered(asked: bytes | None) -> list[float] | None:
    """What `boosted_each` gives for a `message`."""
    if asked is None:
        return None
    n, f, sets, trees, rate = struct.unpack_from("<4id", asked)
    v = np.frombuffer(asked, "<f8", n * f + n + sets * f, 24)
    x, y, new = v[: n * f].reshape(f, n).T, v[n * f : n * f + n], v[n * f + n :].reshape(sets, f)
    ends = np.frombuffer(asked, "<i4", sets, 24 + v.nbytes)
    return [float(o) for i in range(0, sets, SIDE) for o in boosted_each(x, y, ends[i : i + SIDE], new[i : i + SIDE], trees, rate)]


def answers(spark: SparkSession, asked: str) -> Column:
    """`answered` of a column of messages: in the JVM's vector registers, or by numpy where Java lacks its vector module."""
    if java_function(spark, "lonja_boosted", "lonja.Boosting", Path(__file__).with_name("Boosting.java"), "array<double>"):
        return F.call_function("lonja_boosted", F.col(asked))
    return F.udf(answered, "array<double>")(asked)


def features(y: np.ndarray, day: np.ndarray, ahead: int, off: np.ndarray) -> np.ndarray:
    """Row t: what is known `ahead` places before t about the value at t; NaN where the lags reach before the series."""
    n = len(y)
    cols = []
    for k in LAGS:
        k += ahead - 1
        cols.append(np.concatenate([np.full(min(k, n), np.nan), y[: max(n - k, 0)]]))
    nxt = np.minimum(off[np.minimum(np.searchsorted(off, day), len(off) - 1)] - day, 30)
    month = day.astype("datetime64[D]").astype("datetime64[M]").astype(int) % 12 + 1
    return np.stack([*cols, (day + 3) % 7, month, np.isin(day, off), np.maximum(nxt, 0)], 1).astype(float)


def origins(start: int, n: int, ahead: int, most: int) -> list[int]:
    """At most `most` origins, evenly chosen from start .. n - ahead - 1."""
    size = n - ahead - start
    return list(range(start, n - ahead)) if size <= most else [start + k * size // most for k in range(most)]


def regressed(y: np.ndarray, m: np.ndarray | None, ts: np.ndarray, ahead: int) -> np.ndarray:
    """For each t the forecast of y[t + ahead] by least squares: y on a constant and the y, and m, of `ahead` places before, up to t.

    Sums over the rows before t serve all fits; where they tell the columns apart badly, that fit is made from its rows.
    """
    k, n = ts + 1 - ahead, len(y) - ahead
    y0 = np.rint(y.mean())  # of whole numbers the sums stay exact
    a, b, c = y - y0, y[ahead:] - y0, None if m is None else m - np.rint(m.mean())
    upto = lambda v: v[:n].cumsum()[np.maximum(k, 1) - 1]
    both = lambda u, v: k * upto(u[:n] * v[:n]) - upto(u) * upto(v)
    apart = lambda u: both(u, u) > 1e-6 * k * upto(u[:n] * u[:n])
    aa, ab, good = both(a, a), both(a, b), (k > 2) & apart(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        if c is None:
            out = upto(b) + ab / aa * (k * a[ts] - upto(a))
        else:
            cc, ac, cb = both(c, c), both(a, c), both(c, b)
            det = aa * cc - ac * ac
            good &= apart(c) & (det > 1e-6 * aa * cc)
            out = upto(b) + (ab * cc - cb * ac) / det * (k * a[ts] - upto(a)) + (cb * aa - ab * ac) / det * (k * c[ts] - upto(c))
        out = out / k + y0
    for i in np.flatnonzero(~good):
        t = ts[i]
        cols = [v[: t + 1 - ahead] for v in (y, m) if v is not None]
        w = np.linalg.lstsq(np.stack([*cols, np.ones(len(cols[0]))], 1), y[ahead : t + 1], rcond=None)[0]
        out[i] = np.dot(w, [*(v[t] for v in (y, m) if v is not None), 1.0])
    return out


def refitted(df: DataFrame, value: str, volume: str, ahead: int | Sequence[int] = 1, most: int = 60, rows: int = 30, models: Sequence[str] = ("gbm", "ar1", "ar1_volumen"), keys: Sequence[str] = SERIES, order: str = "fecha", final: bool = False) -> DataFrame:
    """keys, metodo, mae, origenes of models that are fitted anew at each origin: `gbm`, `ar1`, `ar1_volumen`;
    `estacional` and `tendencia` are those of windows.forecasts. final: also sigma, the population deviation
    of the signed errors, and punto, the forecast `ahead` median steps after the last date. Of several
    ahead each is judged by itself, and h tells which.

    A model leaves out series of fewer values than its LEAST, ar1_volumen also those of fewer than 90
    volumes, and gbm origins with fewer than `rows` rows to fit to; origins are chosen from its FIRST on.
    Missing volumes carry the last one on, leading ones the first. Errors are in the units of value.
    """

    aheads = (ahead,) if isinstance(ahead, int) else tuple(ahead)

    def kernel(b: Block) -> dict[str, np.ndarray]:
        out: dict[str, list] = {k: [] for k in (*keys, "h", "metodo", "mae", "origenes", "sigma", "punto", "_asked", "_real")}
        offs: dict[tuple[int, int], np.ndarray] = {}
        for s, e in zip(b.starts, b.ends):
            there = ~np.isnan(b["_y"][s:e])
            y, day, m = b["_y"][s:e][there], b[order][s:e][there].astype(np.int64), b["_m"][s:e][there]
            n = len(y)
            able = [k for k in models if n >= LEAST[k]]
            if not able:
                continue
            first, last = (int(str(np.datetime64(int(d), "D"))[:4]) for d in (day[0], day[-1]))
            step = max(1, round(float(np.median(np.diff(day)))))
            later = day[-1] + step * np.arange(1, max(aheads) + 1)
            last = max(last, int(str(np.datetime64(int(later[-1]), "D"))[:4]))
            if (first, last) not in offs:
                offs[first, last] = np.array([d.toordinal() - 719163 for d in holidays(first, last + 1)])
            off = offs[first, last]
            have = ~np.isnan(m)
            if have.sum() >= 90:
                at = np.maximum.accumulate(np.where(have, np.arange(n), -1))
                m = np.where(at >= 0, m[np.maximum(at, 0)], m[np.argmax(have)])
            else:
                able = [k for k in able if k != "ar1_volumen"]

            def made(name: str, ts: np.ndarray, ahead: int) -> np.ndarray:
                if name == "estacional":
                    return y[ts - 4]
                if name == "tendencia":
                    w = y[ts[:, None] + np.arange(-4, 1)]
                    return w.mean(1) + w @ np.arange(-2, 3) / 10 * (2 + ahead)
                return regressed(y, m if name == "ar1_volumen" else None, ts, ahead)

            for ahead in aheads:
                x = features(np.r_[y, np.full(ahead, np.nan)], np.r_[day, later[:ahead]], ahead, off)
                known = ~np.isnan(x[:n]).any(1)
                for name in able:
                    first_origin = max(FIRST[name], LAGS[-1] + ahead - 1) if name == "gbm" else FIRST[name]
                    ts = origins(first_origin, n, ahead, most)
                    es, asked = np.empty(0), None
                    if name == "gbm":
                        to = np.array(ts + [n - 1] * final, int)
                        ends = np.searchsorted(np.flatnonzero(known), to, "right")
                        ts = [t for t, e in zip(ts, ends) if e >= rows]
                        if ts:
                            enough = ends >= rows
                            asked = message(x[:n][known], y[known], ends[enough], x[to[enough] + ahead])
                    else:
                        es = made(name, to := np.array(ts, int), ahead) - y[to + ahead]
                    if not ts:
                        continue
                    for k in keys:
                        out[k].append(b[k][s])
                    out["h"].append(ahead)
                    out["metodo"].append(name)
                    out["origenes"].append(len(ts))
                    out["mae"].append(None if asked else float(np.mean(np.abs(es))))
                    out["sigma"].append(None if asked else float(np.std(es)))
                    out["punto"].append(float(made(name, np.array([n - 1]), ahead)[0]) if final and not asked else None)
                    out["_asked"].append(asked)
                    out["_real"].append([float(y[t + ahead]) for t in ts] if asked else None)
        real = pa.chunked_array([pa.array(out.pop("_real"), pa.list_(pa.float64()))])
        floats = ("mae", "sigma", "punto")
        return {k: np.array(v, object if k in ("metodo", "_asked") else float if k in floats else None) for k, v in out.items()} | {"_real": real}

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", h int, metodo string, mae double, origenes bigint, sigma double, punto double, _asked binary, _real array<double>"
    present = F.col(order).isNotNull()
    for k in keys:
        present &= F.col(k).isNotNull()
    taken = df.where(present).select(*keys, order, F.col(value).cast("double").alias("_y"), F.col(volume).cast("double").alias("_m"))
    made = map_series(taken, kernel, schema, keys, order, target_rows=5_000, tasks=6 * df.sparkSession.sparkContext.defaultParallelism)
    if "gbm" in models:
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e) / F.col("origenes")
        made = made.withColumn("_fits", answers(df.sparkSession, "_asked"))
        made = made.withColumn("_es", F.zip_with(F.slice("_fits", 1, F.size("_real")), "_real", lambda g, y: g - y))
        made = made.withColumn("mae", F.coalesce("mae", mean(F.transform("_es", F.abs))))
        if final:
            made = made.withColumn("_mean", mean(F.col("_es")))
            made = made.withColumn("sigma", F.coalesce("sigma", F.sqrt(mean(F.transform("_es", lambda e: (e - F.col("_mean")) * (e - F.col("_mean")))))))
            made = made.withColumn("punto", F.coalesce("punto", F.element_at("_fits", -1)))
    return made.select(*keys, *["h"] * (not isinstance(ahead, int)), "metodo", "mae", "origenes", *["sigma", "punto"] * final)
