"""Irregular readings onto a regular grid, by the increments of a cumulative counter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, StructField, StructType

from lonja.operators.series import SERIES, Block, has_value, map_series

#: Days that one series may span within the joint axis of a block.
SPAN = 1 << 22


def running_total(value: np.ndarray, series: np.ndarray) -> np.ndarray:
    """The counter without its resets, counted from its first reading in each series.

    A reading below the one before is a reset: the counter began again at 0, so the reading
    itself is the increment.
    """
    step = np.diff(value, prepend=0.0)
    step = np.where(step < 0, value, step)
    step[np.r_[True, series[1:] != series[:-1]]] = 0.0
    return np.cumsum(step)


def on_cells(day: np.ndarray, total: np.ndarray, series: np.ndarray, cell: np.ndarray, of: np.ndarray, width: int = 1) -> np.ndarray:
    """Increment of each cell (the `width` days that end with day `cell` of series `of`).

    day, total: readings of a running total, sorted by (series, day). An interval between two
    readings is shared out to the cells in proportion to its overlap with them. NaN where a cell
    is not inside the series' first and last reading.
    """
    if not len(day):
        return np.full(len(cell), np.nan)
    base = day.min() - width
    axis = series * SPAN + (day - base)
    end = of * SPAN + (cell - base)
    grown = np.interp(end, axis, total) - np.interp(end - width, axis, total)
    first = np.searchsorted(axis, of * SPAN)
    last = np.searchsorted(axis, (of + 1) * SPAN) - 1
    inside = first <= last
    first, last = np.minimum(first, len(axis) - 1), np.maximum(last, 0)
    inside &= (end - width >= axis[first]) & (end <= axis[last])
    return np.where(inside, grown, np.nan)


def regular(df: DataFrame, value: str, keys: Sequence[str] = SERIES, source: str = "mercado_id", order: str = "fecha", kind: str = "level", longest: int | None = None) -> DataFrame:
    """One row for each series and day of its source, from the series' first to its last row.

    The days of a source are those on which any of its series has a row. df has at most one row
    for each (keys, order). Result: keys, order, `{value}` on the day, `sin_lectura` (the day has
    no reading of its own: no row, or one without value).

    kind "counter": value is a cumulative count with resets; a day gets its share of the increment
    between the readings around it. kind "level": value holds for the days since the reading
    before, so the running total of value x days is the counter, and a day's increment is the level: a day
    without a reading gets that of the next one (back-fill), which speaks for the days it had to cover.
    Days before the first reading get none for a level but that of its own day, nor do days after
    the last one; days in an interval of over `longest` days stay null, marked as all days without
    reading are. Null and NaN are no reading. Rows with a null key or date are on no calendar and
    left out. Empty input: empty result. The days of a source travel as one array for each series,
    bounded by the calendar.
    """
    present = F.col(order).isNotNull()
    for k in {*keys, source}:
        present &= F.col(k).isNotNull()
    rows = df.where(present)
    days = rows.groupBy(F.col(source).alias("_source")).agg(F.sort_array(F.collect_set(order)).alias("_days"))
    series = rows.select(*keys, F.col(source).alias("_source")).distinct().join(days, "_source").select(*keys, F.lit(None).cast("date").alias(order), F.lit(None).cast("double").alias("_v"), "_days")
    read = rows.select(*keys, order, F.when(has_value(F.col(value).cast("double")), F.col(value).cast("double")).alias("_v"), F.lit(None).cast(ArrayType(DateType())).alias("_days"))
    schema = StructType([*(StructField(k, df.schema[k].dataType) for k in keys), StructField(order, DateType()), StructField(value, DoubleType()), StructField("sin_lectura", BooleanType())])

    def kernel(b: Block) -> dict[str, np.ndarray]:
        lists = b.columns.column("_days").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        head = np.zeros(b.n, bool)  # a series begins with the row that carries its calendar
        head[b.starts] = True
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cell = lists.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(b.series, count)
        row = np.flatnonzero(~head)
        day, at, v = b[order][row].astype(np.int64), b.series[row], b["_v"][row]
        low, high = day[np.searchsorted(at, np.arange(len(b.starts)))], day[np.searchsorted(at, np.arange(len(b.starts)), side="right") - 1]
        keep = (cell >= low[of]) & (cell <= high[of])
        cell, of = cell[keep], of[keep]
        real = ~np.isnan(v)
        day, at, v = day[real], at[real], v[real]
        opens = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        since = np.where(opens, 1, np.diff(day, prepend=0))
        if kind == "level":
            # The first reading of a series holds for its own day: its total starts a day before.
            total = np.cumsum(v * since)
            extra = np.flatnonzero(opens)
            x_day, x_at = np.insert(day, extra, day[extra] - 1), np.insert(at, extra, at[extra])
            x_total = np.insert(total, extra, total[extra] - v[extra])
        else:
            x_day, x_at, x_total = day, at, running_total(v, at)
        filled = on_cells(x_day, x_total, x_at, cell, of)
        base = min(cell.min(initial=0), day.min(initial=0))
        axis, want = at * SPAN + (day - base), of * SPAN + (cell - base)
        where = np.searchsorted(axis, want)
        safe = np.minimum(where, max(len(axis) - 1, 0))
        own = (where < len(axis)) & (axis[safe] == want) if len(axis) else np.zeros(len(cell), bool)
        if len(axis):
            if kind == "level":
                filled = np.where(own, v[safe], filled)
            if longest is not None:
                filled = np.where(~own & (since[safe] > longest), np.nan, filled)
        out = {k: b[k][b.starts][of] for k in keys}
        return out | {order: cell.astype("datetime64[D]"), value: filled, "sin_lectura": ~own}

    return map_series(series.unionByName(read), kernel, schema, keys, order)
