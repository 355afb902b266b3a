"""Window operators over series: previous values, levels, trends, runs, samples.

Every function takes a DataFrame with at most one row for each (keys, order) and adds columns or
picks rows; windows partition by the series, so one shuffle serves all that follow on the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lonja.operators.series import SERIES, Block, map_series


def ordered(keys: Sequence[str] = SERIES, order: str = "fecha"):
    return Window.partitionBy(*keys).orderBy(order)


def latest(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """The last row of each series, by a maximum that is taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    top = df.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return top.select(*keys, *[F.col("_r")[c].alias(c) for c in (order, *rest)])


def previous(value: str, keys: Sequence[str] = SERIES, order: str = "fecha") -> Column:
    """The last value before the row; rows without value are passed over."""
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def change(value: str, keys: Sequence[str] = SERIES, order: str = "fecha") -> Column:
    """(value - previous) / previous; null without either or after 0."""
    before = previous(value, keys, order)
    return F.try_divide((F.col(value) - before).cast("double"), before.cast("double"))


def tail(df: DataFrame, value: str, n: int, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """The last n rows with a value of each series."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.where(F.col(value).isNotNull()).withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def sampled(df: DataFrame, points: int, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """Every ceil(n / points)-th row of a series, and its last one."""
    place = F.row_number().over(ordered(keys, order)) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    rows = df.withColumns({"_i": place, "_n": size})
    step = F.ceil(F.col("_n") / F.lit(points))
    return rows.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def evenly(df: DataFrame, points: int, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """At most `points` rows of a series at even distances, the last of them its last row."""
    rows = df.withColumns({"_i": F.row_number().over(ordered(keys, order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    # Row i is picked if it is floor(k * n / points) for a k below points - 1.
    k = F.ceil(F.col("_i") * F.lit(points) / F.col("_n")).cast("bigint")
    picked = (k < points - 1) & (F.floor(k * F.col("_n") / F.lit(points)) == F.col("_i"))
    return rows.where((F.col("_n") <= points) | picked | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def of_market(df: DataFrame, markets: DataFrame, code: str, market: str = "mercado_id") -> DataFrame:
    """The rows of the market with a code (markets: `market`, codigo); all rows if none has."""
    asked = markets.where(F.col("codigo") == code).select(market)
    there = asked.agg((F.count("*") > 0).alias("_there"))  # one row
    marked = df.join(asked.withColumn("_own", F.lit(True)), market, "left").crossJoin(F.broadcast(there))
    return marked.where(F.col("_own") | ~F.col("_there")).drop("_own", "_there")


def islands(df: DataFrame, value: str, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """keys, tramo, desde, hasta, n: the unbroken runs of rows with a value."""
    broken = F.sum(F.col(value).isNull().cast("int")).over(ordered(keys, order))
    runs = df.withColumn("_i", broken).where(F.col(value).isNotNull())
    found = runs.groupBy(*keys, "_i").agg(F.min(order).alias("desde"), F.max(order).alias("hasta"), F.count("*").alias("n"))
    return found.withColumn("tramo", F.row_number().over(Window.partitionBy(*keys).orderBy("desde"))).drop("_i")


def carried(value: str, keys: Sequence[str] = SERIES, order: str = "fecha") -> Column:
    """The last value up to the row; before the first value, the first one."""
    w = ordered(keys, order)
    back = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), back)


def median_gap(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """keys, paso: the median number of days between rows; null for a single row."""
    gap = F.datediff(order, F.lag(order).over(ordered(keys, order)))
    return df.select(*keys, gap.alias("_g")).groupBy(*keys).agg(F.median("_g").alias("paso"))


def robust_z(df: DataFrame, value: str, history: int = 30, least: int = 6, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """keys, order, `{value}`, z: each value against the median and MAD of the `history` values before it.

    z = (value - median) / (1.4826 MAD); if the MAD is 0, the population deviation takes its place;
    if that is 0 too, 99 with the sign of the difference, null where there is none. Null with fewer
    than `least` values before. Rows without value are left out, as are those with null keys or date.
    """
    present = F.col(value).isNotNull() & F.col(order).isNotNull()
    for k in keys:
        present &= F.col(k).isNotNull()
    schema = StructType([*(df.schema[k] for k in [*keys, order]), StructField(value, LongType()), StructField("z", DoubleType())])

    def kernel(b: Block) -> dict[str, np.ndarray]:
        v = b["_v"]
        n = len(v)
        at = np.arange(n)[:, None] - np.arange(history, 0, -1)[None, :]
        use = (at >= 0) & (at >= b.starts[b.series][:, None])
        w = np.where(use, v[np.clip(at, 0, n - 1)], np.inf)
        count = use.sum(1)

        def middle(x: np.ndarray) -> np.ndarray:
            x = np.sort(x, axis=1)
            i = np.arange(n)
            return (x[i, np.maximum((count - 1) // 2, 0)] + x[i, np.minimum(count // 2, history - 1)]) / 2

        with np.errstate(invalid="ignore", divide="ignore"):
            centre = np.where(count > 0, middle(w), np.nan)
            mad = middle(np.where(use, np.abs(w - centre[:, None]), np.inf)) * 1.4826
            total, square = np.where(use, w, 0).sum(1), np.where(use, w * w, 0).sum(1)
            spread = np.sqrt(np.maximum(count * square - total * total, 0)) / count
            scale = np.where(mad > 0, mad, spread)
            z = np.where(scale > 0, (v - centre) / scale, np.where(v == centre, np.nan, np.sign(v - centre) * 99))
        z = np.where(count >= least, z, np.nan)
        return {k: b.columns.column(k) for k in [*keys, order]} | {value: v.astype(np.int64), "z": z}

    return map_series(df.where(present).select(*keys, order, F.col(value).cast("double").alias("_v")), kernel, schema, keys, order)


def anomalies(df: DataFrame, values: dict[str, str], level: float = 3.5, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """keys, tipo, order, valor, z: where the robust z of a value is at least `level`; values: the column of each tipo."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("tipo"), F.col(c).cast("bigint").alias("valor")) for k, c in values.items()]))
    stacked = df.select(*keys, order, parts.alias("_x")).select(*keys, "_x.tipo", order, "_x.valor")
    return robust_z(stacked, "valor", keys=[*keys, "tipo"], order=order).where(F.abs("z") >= level)


def forecasts(df: DataFrame, value: str, ahead: int = 1, warm: int = 30, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """keys, i, n, real, estacional, tendencia, ar1: one-pass walk-forward forecasts from every origin.

    i: place of the origin among the rows with a value (from 0), at least `warm` - 1; real: the value
    `ahead` places later. estacional: the value five places before the one after the origin.
    tendencia: the line through the last five values. ar1: y[t] on y[t - ahead], fitted to all values
    up to the origin; a constant regressor gives the least-norm solution. Nothing after the origin is used.
    """
    w = ordered(keys, order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("bigint").alias("y"))
    lags = {f"_l{k}": F.lag("y", k).over(w) for k in range(1, 5)}
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(*keys)), "real": F.lead("y", ahead).over(w), "_x": F.lag("y", ahead).over(w), **lags})
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("_x").isNotNull()
    sums = {"_c": F.count("_x"), "_sx": F.sum("_x"), "_sy": F.sum(F.when(both, F.col("y"))), "_sxx": F.sum(F.col("_x") * F.col("_x")), "_sxy": F.sum(F.col("_x") * F.col("y"))}
    rows = rows.withColumns({k: v.over(past).cast("double") for k, v in sums.items()})
    c, sx, sy, sxx, sxy, y = (F.col(k) for k in ("_c", "_sx", "_sy", "_sxx", "_sxy", "y"))
    slope_bottom = c * sxx - sx * sx
    a = F.try_divide(c * sxy - sx * sy, slope_bottom)
    flat = sx / c
    ar1 = F.when(c < 5, None).when(slope_bottom != 0, a * y + (sy - a * sx) / c).otherwise((flat * y + 1) * (sy / c) / (flat * flat + 1))
    total = y + F.col("_l1") + F.col("_l2") + F.col("_l3") + F.col("_l4")
    tilt = 2 * y + F.col("_l1") - F.col("_l3") - 2 * F.col("_l4")
    line = total / F.lit(5.0) + tilt / F.lit(10.0) * F.lit(2.0 + ahead)
    out = rows.where((F.col("i") >= warm - 1) & F.col("real").isNotNull())
    return out.select(*keys, "i", "n", "real", F.col("_l4").cast("double").alias("estacional"), line.alias("tendencia"), ar1.alias("ar1"))


def walk_forward(made: DataFrame, methods: Sequence[str], warm: int = 30, ahead: int = 1, most: int = 60, keys: Sequence[str] = SERIES) -> DataFrame:
    """keys, metodo, mae, origenes: mean absolute error of each method over at most `most` evenly chosen origins."""
    size = F.col("n") - ahead - (warm - 1)
    place = F.col("i") - (warm - 1)
    # The origin is one of int(k * size / most) for k in 0..most-1.
    k = F.ceil(place * F.lit(most) / size).cast("bigint")
    chosen = (size <= most) | ((k < most) & (F.floor(k * size / F.lit(most)) == place))
    picked = made.where(chosen)
    errors = F.explode(F.array(*[F.struct(F.lit(m).alias("metodo"), F.abs(F.col(m) - F.col("real")).alias("e")) for m in methods]))
    flat = picked.select(*keys, errors.alias("x")).select(*keys, "x.metodo", F.floor(F.col("x.e") * 1000 + 0.5).cast("bigint").alias("e")).where(F.col("e").isNotNull())
    return flat.groupBy(*keys, "metodo").agg((F.sum("e") / F.count("*") / 1000).alias("mae"), F.count("*").alias("origenes"))
