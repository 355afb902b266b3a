"""Filling missing cells by a mixture of Gaussian and categorical columns, fitted by EM.

The fit is distributed: every pass over the rows yields, for each task, the expected sufficient
statistics of each component (weights, first and second moments, category counts). They are
summed by Spark, so the driver gets a table whose size depends on the model alone. All rows take
part in every pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from lonja.operators.series import SERIES, Block, map_series
from lonja.operators.usable import Range
from lonja.session import written


@dataclass(frozen=True)
class Field:
    """A numeric column of the model: log(value + offset) against the level of its series.

    level: columns with one level name share the median of their logarithms within a series.
    shift: 0 the row itself, -1 the row before in the series, 1 the row after.
    """

    column: str
    range: Range
    level: str
    offset: float = 0.0
    shift: int = 0

    @property
    def name(self) -> str:
        return f"x_{self.column}_{'abc'[self.shift + 1]}"


@dataclass
class Mixture:
    """Parameters: weights (k), means (k, d), covariances (k, d, d), a (k, levels) table for each category."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    tables: list[np.ndarray]
    loglik: list[float] = field(default_factory=list)

    @staticmethod
    def start(mean: np.ndarray, var: np.ndarray, levels: Sequence[int], components: int) -> Mixture:
        """Components around one mean, from narrow to wide; nothing is drawn at random."""
        spread = 4.0 ** np.arange(1 - components // 2 - components % 2, components // 2 + 1)[:components]
        weight = 0.5 ** np.arange(1, components + 1)
        nudge = np.linspace(-0.1, 0.1, components)[:, None] * np.sqrt(var)
        cov = np.stack([np.diag(var * s) for s in spread])
        return Mixture(weight / weight.sum(), mean + nudge, cov, [np.full((components, n), 1 / n) for n in levels])

    def expect(self, x: np.ndarray, cats: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], float]:
        """Responsibilities (n, k), expected values given what is there (n, k, d), the conditional
        covariances by pattern of missing cells as (rows, missing columns, (k, m, m)), log likelihood."""
        n, d = x.shape
        k = len(self.weight)
        logp = np.tile(np.log(self.weight), (n, 1))
        for c, t in zip(cats, self.tables):
            there = c >= 0
            logp[there] += np.log(t[:, c[there]].T)
        filled = np.repeat(np.nan_to_num(x)[:, None, :], k, axis=1)
        spread = []
        gone = np.isnan(x)
        code = gone @ (1 << np.arange(d))
        for pattern in np.unique(code):
            rows = np.flatnonzero(code == pattern)
            miss = np.flatnonzero(pattern >> np.arange(d) & 1)
            seen = np.setdiff1d(np.arange(d), miss)
            rest = np.zeros((k, len(miss), len(miss)))
            for j in range(k):
                s = self.cov[j]
                if len(seen):
                    low = np.linalg.cholesky(s[np.ix_(seen, seen)])
                    inv = np.linalg.inv(low)
                    off = x[np.ix_(rows, seen)] - self.mean[j, seen]
                    z = off @ inv.T
                    logp[rows, j] -= 0.5 * (z * z).sum(1) + np.log(np.diag(low)).sum() + 0.5 * len(seen) * np.log(2 * np.pi)
                    if len(miss):
                        gain = s[np.ix_(miss, seen)] @ inv.T @ inv
                        filled[rows[:, None], j, miss] = self.mean[j, miss] + off @ gain.T
                        rest[j] = s[np.ix_(miss, miss)] - gain @ s[np.ix_(seen, miss)]
                else:
                    filled[rows[:, None], j, miss] = self.mean[j, miss]
                    rest[j] = s[np.ix_(miss, miss)]
            if len(miss):
                spread.append((rows, miss, rest))
        top = logp.max(1, keepdims=True)
        p = np.exp(logp - top)
        total = p.sum(1, keepdims=True)
        return p / total, filled, spread, float((np.log(total) + top).sum())

    def statistics(self, x: np.ndarray, cats: Sequence[np.ndarray]) -> np.ndarray:
        """Expected sufficient statistics of some rows, as one vector; vectors of tasks add up."""
        r, filled, spread, loglik = self.expect(x, cats)
        k, d = self.mean.shape
        second = np.stack([(filled[:, j] * r[:, j, None]).T @ filled[:, j] for j in range(k)])
        for rows, miss, rest in spread:
            second[:, miss[:, None], miss] += r[rows].sum(0)[:, None, None] * rest
        parts = [r.sum(0), np.einsum("nk,nkd->kd", r, filled).ravel(), second.ravel()]
        for c, t in zip(cats, self.tables):
            there = c >= 0
            count = np.stack([np.bincount(c[there], r[there, j], t.shape[1]) for j in range(k)])
            parts.append((count + r[~there].sum(0)[:, None] * t).ravel())
        return np.concatenate([[len(x), loglik], *parts])

    def maximised(self, s: np.ndarray, ridge: float = 1e-4) -> Mixture:
        """The next parameters, from the summed statistics."""
        k, d = self.mean.shape
        n, loglik = s[:2]
        parts = np.split(s[2:], np.cumsum([k, k * d, k * d * d, *(t.size for t in self.tables)])[:-1])
        w = parts[0] + 1e-9
        mean = parts[1].reshape(k, d) / w[:, None]
        cov = parts[2].reshape(k, d, d) / w[:, None, None] - mean[:, :, None] * mean[:, None, :]
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)
        empty = parts[0] < d + 1  # a component without rows keeps its shape
        mean[empty], cov[empty] = self.mean[empty], self.cov[empty]
        tables = [(p.reshape(t.shape) + 0.5) / (p.reshape(t.shape) + 0.5).sum(1, keepdims=True) for p, t in zip(parts[3:], self.tables)]
        return Mixture((parts[0] + 1) / (n + k), mean, cov, tables, [*self.loglik, loglik])


def fill(
    df: DataFrame,
    fields: Sequence[Field],
    targets: Sequence[str],
    category: str | None = None,
    keys: Sequence[str] = SERIES,
    order: str = "fecha",
    components: int = 4,
    passes: int = 6,
    tolerance: float = 1e-3,
    most_levels: int = 64,
) -> DataFrame:
    """Every cell of `targets` (and of `category`) without a usable value, filled and marked.

    Returns keys, order, and for each target `{c}` (the value, or the conditional expectation of
    its logarithm given the row's other cells and its neighbours in the series) and `{c}_relleno`
    (true where filled); for `category` its most likely level and the same mark.

    fields: the model's columns; each target must be among them with shift 0. A value outside its
    range counts as missing, as do null and NaN. The weekday of `order` is a category of the model.
    A series without any value takes the level of all series. A row with a null key is a series of
    its own; a null date gives no weekday and no neighbours. No usable value at all: filled null,
    marked. Empty input: empty result. Fitting stops after `passes`, or when the log likelihood
    a row gains less than `tolerance`. `category` with more than `most_levels` levels is refused.
    """
    levels = sorted({f.level for f in fields})
    raw = list(dict.fromkeys(f.column for f in fields))
    cats = {"c_weekday": 7}
    names: list[str] = []
    read = [F.col(c).cast("double").alias(c) for c in raw]
    if category:
        names = [r[0] for r in df.where(F.col(category).isNotNull()).select(category).distinct().orderBy(category).limit(most_levels + 1).collect()]
        if len(names) > most_levels:
            raise ValueError(f"{category} has more than {most_levels} levels")
        cats["c_category"] = max(1, len(names))
        pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]
        code = F.coalesce(F.create_map(*pairs)[F.col(category)], F.lit(-1)) if names else F.lit(-1)
        read.append(code.cast("int").alias("c_category"))
    key_fields = [StructField(k, df.schema[k].dataType) for k in [*keys, order]]
    schema = StructType(
        [
            *key_fields,
            *(StructField(c, DoubleType()) for c in targets),
            *(StructField(f"l_{v}", DoubleType()) for v in levels),
            *(StructField(f.name, FloatType()) for f in fields),
            *(StructField(c, IntegerType()) for c in cats),
        ]
    )

    def features(b: Block) -> dict[str, np.ndarray]:
        logs = {}
        for f in fields:
            v = b[f.column]
            ok = f.range.mask(v)
            logs[f.column] = np.where(ok, np.log(np.where(ok, v, 1) + f.offset), np.nan)
        out = {f"l_{v}": _medians([logs[c] for c in raw if any(f.column == c and f.level == v for f in fields)], b) for v in levels}
        day = b[order].astype(float)
        first, last = np.zeros(b.n, bool), np.zeros(b.n, bool)
        first[b.starts], last[b.ends - 1] = True, True
        for f in fields:
            v = logs[f.column]
            if f.shift:
                v = np.roll(v, -f.shift)
                edge = (last if f.shift > 0 else first) | np.isnan(day) | np.isnan(np.roll(day, -f.shift))
                v = np.where(edge, np.nan, v)
            out[f.name] = (v - out[f"l_{f.level}"]).astype(np.float32)
        out["c_weekday"] = np.where(np.isnan(day), -1, (np.nan_to_num(day).astype(int) + 3) % 7).astype(np.int32)
        if category:
            out["c_category"] = b["c_category"]
        for f in fields:
            if f.column in targets and not f.shift:
                out[f.column] = np.where(f.range.mask(b[f.column]), b[f.column], np.nan)
        return out | {k: b.columns.column(k) for k in [*keys, order]}

    table = written(map_series(df.select(*keys, order, *read), features, schema, keys, order), "em")
    model, base = fit(table, fields, cats, components, passes, tolerance, levels)
    out_schema = StructType(
        [
            *key_fields,
            *(x for c in targets for x in (StructField(c, DoubleType()), StructField(f"{c}_relleno", BooleanType()))),
            *([StructField(category, StringType()), StructField(f"{category}_relleno", BooleanType())] if category else []),
        ]
    )
    arrow = to_arrow_schema(out_schema)
    place = {f.column: i for i, f in enumerate(fields) if not f.shift}
    by_column = {f.column: f for f in fields if not f.shift}

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, codes = _matrix(b, fields, cats)
            out = {k: b.column(k) for k in [*keys, order]}
            need = np.isnan(np.stack([_numbers(b, c) for c in targets], 1)).any(1) | (codes[-1] < 0)
            rows = np.flatnonzero(need)  # complete rows need no expectation
            r, filled, _, _ = model.expect(x[rows], [c[rows] for c in codes])
            guess = np.einsum("nk,nkd->nd", r, filled)
            for c in targets:
                v, f = _numbers(b, c).copy(), by_column[c]
                gone = np.isnan(v)
                level = np.where(np.isnan(_numbers(b, f"l_{f.level}")), base[f.level], _numbers(b, f"l_{f.level}"))
                at = gone[rows]
                v[rows[at]] = np.clip(np.exp(guess[at, place[c]] + level[rows[at]]) - f.offset, f.range.low, f.range.high)
                out[c] = pa.array(v, from_pandas=True)
                out[f"{c}_relleno"] = pa.array(gone)
            if category:
                gone = codes[-1] < 0
                pick = codes[-1].copy()
                if names:
                    pick[rows] = np.where(pick[rows] < 0, (r @ model.tables[-1]).argmax(1), pick[rows])
                out[category] = pa.array([names[i] if names else None for i in pick], pa.string())
                out[f"{category}_relleno"] = pa.array(gone)
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return table.mapInArrow(complete, out_schema)


def fit(table: DataFrame, fields: Sequence[Field], cats: dict[str, int], components: int, passes: int, tolerance: float, levels: Sequence[str]) -> tuple[Mixture, dict[str, float]]:
    """EM over all rows of the feature table. Also the mean level of all series, by level name."""
    moments = [x for f in fields for x in (F.avg(F.nanvl(f.name, F.lit(None))), F.var_pop(F.nanvl(f.name, F.lit(None))))]
    row = table.agg(*moments, *[F.avg(F.nanvl(f"l_{v}", F.lit(None))) for v in levels]).first()
    d = len(fields)
    mean = np.array([row[2 * i] or 0.0 for i in range(d)])
    var = np.array([max(row[2 * i + 1] or 0.0, 1e-3) for i in range(d)])
    base = {v: float("nan") if row[2 * d + i] is None else row[2 * d + i] for i, v in enumerate(levels)}
    model = Mixture.start(mean, var, list(cats.values()), components)
    reading = table.select(*[f.name for f in fields], *cats)
    for _ in range(passes):

        def pass_over(batches: Iterator[pa.RecordBatch], m: Mixture = model) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    s = m.statistics(*_matrix(b, fields, cats))
                    total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        sums = reading.mapInArrow(pass_over, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not sums:
            break
        model = model.maximised(np.array([r.v for r in sums]))
        gains = model.loglik
        if len(gains) > 1 and gains[-1] - gains[-2] < tolerance * sums[0].v:
            break
    return model, base


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(float)


def _matrix(b: pa.RecordBatch, fields: Sequence[Field], cats: dict[str, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.stack([_numbers(b, f.name) for f in fields], 1), [b.column(c).to_numpy(zero_copy_only=False).astype(int) for c in cats]


def _medians(columns: Sequence[np.ndarray], b: Block) -> np.ndarray:
    """Median of the values of each series, on each of its rows; NaN where there is none."""
    v = np.concatenate(columns)
    s = np.concatenate([b.series] * len(columns))
    ok = ~np.isnan(v)
    v, s = v[ok], s[ok]
    at = np.lexsort((v, s))
    v, s = v[at], s[at]
    n = np.bincount(s, minlength=len(b.starts))
    start = np.cumsum(n) - n
    out = np.full(len(b.starts), np.nan)
    has = n > 0
    lo, hi = (start + (n - 1) // 2)[has], (start + n // 2)[has]
    out[has] = (v[lo] + v[hi]) / 2
    return out[b.series]
