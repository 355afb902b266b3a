"""Totals and means over trailing calendar periods, by banded operators on dense day tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from lonja.operators.series import SERIES, Block, map_series

#: Values are summed as whole numbers of 1/SCALE, so a sum does not depend on its order.
SCALE = 1e6


def band(window: int, halo: int, tile: int) -> np.ndarray:
    """(halo + tile) x tile matrix of ones: column j sums the `window` days that end on day j."""
    rows, cols = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return ((rows <= cols) & (rows > cols - window)).astype(float)


def trailing_sums(day: np.ndarray, series: np.ndarray, values: dict[str, np.ndarray], windows: Sequence[int], tile: int = 64):
    """Sums over trailing windows for each series and calendar day between its first and last row.

    day, series: of each row, sorted by (series, day), a day at most once in a series.
    values: by name, one number a row; a day without row counts 0.
    Each series is cut into tiles of `tile` days, each tile preceded by a halo of the days
    that the longest window needs. Tiles of all series are the rows of one dense matrix.
    Returns series and day of each output row, the row it comes from (-1: none), and the sums
    by (name, window).
    """
    if not len(day):
        return series, day, day.astype(np.int64), {(n, w): np.zeros(0) for n in values for w in windows}
    halo = max(windows) - 1
    new = np.r_[True, series[1:] != series[:-1]]
    first = day[new]
    last = day[np.r_[np.flatnonzero(new)[1:] - 1, len(day) - 1]]
    code = np.cumsum(new) - 1
    offset = (day - first[code]).astype(np.int64)
    days = (last - first + 1).astype(np.int64)
    tiles = -(-days // tile)
    before = np.cumsum(tiles) - tiles  # tiles of the series before
    n_tiles = int(tiles.sum())
    at_tile = before[code] + offset // tile
    place = offset % tile
    dense = np.zeros((n_tiles, halo + tile))
    sums = {}
    # A row stands in its own tile and in the halo of each later tile that reaches back to it.
    reach = [(at_tile, place + halo)]
    for k in range(1, -(-halo // tile) + 1):
        col = place + halo - k * tile
        ok = (col >= 0) & (at_tile + k < (before + tiles)[code])
        reach.append((np.where(ok, at_tile + k, -1), col))
    bands = {w: band(w, halo, tile) for w in windows}
    valid = (np.arange(tile)[None, :] + (np.arange(n_tiles) - np.repeat(before, tiles))[:, None] * tile) < np.repeat(days, tiles)[:, None]
    for name, v in values.items():
        dense[:] = 0
        for t, col in reach:
            ok = t >= 0
            dense[t[ok], col[ok]] = v[ok]
        for w in windows:
            sums[name, w] = (dense @ bands[w])[valid]
    source = np.full((n_tiles, tile), -1, np.int64)
    source[at_tile, place] = np.arange(len(day))
    out_series = np.repeat(series[new], days)
    out_day = np.repeat(first, days) + (np.arange(int(days.sum())) - np.repeat(np.cumsum(days) - days, days))
    return out_series, out_day, source[valid], sums


def rolling(
    df: DataFrame,
    totals: Sequence[str],
    means: Sequence[str],
    windows: Sequence[int] = (7, 30),
    keys: Sequence[str] = SERIES,
    order: str = "fecha",
    carry: Sequence[str] = (),
    unusable: dict[str, str] | None = None,
    tile: int = 64,
) -> DataFrame:
    """One row for each series and calendar day from its first to its last row.

    df has at most one row for each (keys, order); see `holding_rows`.
    For each column of `totals`: `{c}_total_{w}` and `{c}_media_{w}` (total / w), a day without
    row or value counting 0. For each of `means`: `{c}_media_{w}` over the values there are,
    null if there are none. `{c}_n_{w}` counts the values. `con_fila` marks days that have a row,
    `dias` the days since the first row. `carry` columns (double) come through, null on other days.
    `unusable` names boolean columns (by their output name) whose trues are counted: `{name}_{w}`.

    Nulls and NaN are no value. Rows with a null key or date are on no calendar and are left out.
    Empty input gives an empty result. Columns of the input that clash with output names don't
    matter, as only named columns are read.
    """
    unusable = unusable or {}
    value_cols = list(dict.fromkeys([*totals, *means]))
    kinds = dict(df.dtypes)
    key_fields = [StructField(k, df.schema[k].dataType) for k in keys]
    fields = [*key_fields, StructField(order, DateType()), StructField("con_fila", LongType()), StructField("dias", LongType())]
    fields += [StructField(f"{c}_{x}_{w}", LongType() if x == "n" else DoubleType()) for c in totals for w in windows for x in ("total", "media", "n")]
    fields += [StructField(f"{c}_{x}_{w}", LongType() if x == "n" else DoubleType()) for c in means for w in windows for x in ("media", "n")]
    fields += [StructField(f"{u}_{w}", LongType()) for u in unusable for w in windows]
    fields += [StructField(c, DoubleType()) for c in carry]
    schema = StructType(fields)
    flags = [F.col(c).cast("double").alias(f"_flag_{u}") for u, c in unusable.items()]
    read = [F.col(c).cast("double").alias(f"_v_{c}") for c in dict.fromkeys([*value_cols, *carry])]
    present = F.lit(True)
    for k in [*keys, order]:
        present &= F.col(k).isNotNull()
    rows = df.where(present).select(*keys, order, *read, *flags)
    assert kinds[order] == "date", f"{order} must be a date"
    flag_names = list(unusable)

    def kernel(b: Block) -> dict[str, np.ndarray]:
        values = {}
        for c in value_cols:
            v = b[f"_v_{c}"]
            ok = ~np.isnan(v)
            values[c] = np.where(ok, np.rint(np.where(ok, v, 0) * SCALE), 0)
            values[f"#{c}"] = ok.astype(float)
        for u in flag_names:
            values[f"!{u}"] = np.nan_to_num(b[f"_flag_{u}"])
        series, day, source, sums = trailing_sums(b[order], b.series, values, windows, tile)
        out = {k: b[k][b.starts][series] for k in keys}
        out[order] = day.astype("datetime64[D]")
        out["con_fila"] = (source >= 0).astype(np.int64)
        lengths = np.bincount(series, minlength=len(b.starts)) if len(series) else np.zeros(0, int)
        out["dias"] = np.arange(len(series)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for c in totals:
            for w in windows:
                out[f"{c}_total_{w}"] = sums[c, w] / SCALE
                out[f"{c}_media_{w}"] = sums[c, w] / SCALE / w
                out[f"{c}_n_{w}"] = sums[f"#{c}", w].astype(np.int64)
        for c in means:
            for w in windows:
                n = sums[f"#{c}", w]
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[f"{c}_media_{w}"] = np.where(n > 0, sums[c, w] / SCALE / n, np.nan)
                out[f"{c}_n_{w}"] = n.astype(np.int64)
        for u in flag_names:
            for w in windows:
                out[f"{u}_{w}"] = sums[f"!{u}", w].astype(np.int64)
        for c in carry:
            out[c] = np.where(source >= 0, b[f"_v_{c}"][source], np.nan)
        return out

    return map_series(rows, kernel, schema, keys, order)
