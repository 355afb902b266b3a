"""Series of readings: holding rows, and Arrow kernels over whole series.

A series is the set of rows with one value of `keys`; its rows are ordered by `order`.
After `holding_rows` a series has at most one row a calendar day, so a series is bounded
by the length of its history and never by the number of rows delivered for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SERIES = ("producto_id", "mercado_id")


def holding_rows(df: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str | Column]) -> DataFrame:
    """The row of each key that holds: the one with the latest `version`.

    Last write wins. Rows equal in `version` but not in `columns` are ordered by the columns
    themselves, so the choice never depends on the order of the files. A null version loses
    against any other. Null key values form keys of their own. The maximum is taken before
    the shuffle too, so any number of copies of one key leaves each task as one row.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = df.select(*keys, F.struct(F.col(version).alias("_version"), *named).alias("_held"))
    names = [f.name for f in rows.schema["_held"].dataType.fields[1:]]
    held = rows.groupBy(*keys).agg(F.max("_held").alias("_held"))
    return held.select(*keys, *[F.col("_held")[n].alias(n) for n in names])


def has_value(c: str | Column) -> Column:
    """Neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


class Block:
    """Whole series, one after the other: numpy columns, and where each series starts."""

    def __init__(self, batch: pa.Table, keys: Sequence[str]):
        self.columns = batch
        self.n = batch.num_rows
        self._cache: dict[str, np.ndarray] = {}
        new = np.zeros(self.n, bool)
        new[:1] = True
        for k in keys:
            v = self[k]
            new[1:] |= v[1:] != v[:-1]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], self.n)
        self.series = np.cumsum(new) - 1

    def __getitem__(self, name: str) -> np.ndarray:
        """Numbers with null as NaN; dates as days since 1970."""
        if name not in self._cache:
            col = self.columns.column(name)
            if pa.types.is_date(col.type):
                col = col.cast(pa.int32())
            if pa.types.is_floating(col.type):
                col = col.fill_null(float("nan"))
            self._cache[name] = col.to_numpy()
        return self._cache[name]


def map_series(
    df: DataFrame,
    kernel: Callable[[Block], dict[str, np.ndarray]],
    schema: StructType | str,
    keys: Sequence[str] = SERIES,
    order: str = "fecha",
    target_rows: int = 50_000,
    tasks: int | None = None,
) -> DataFrame:
    """Run `kernel` over whole, ordered series; blocks of about `target_rows` rows reach it.

    One shuffle by `keys`, a sort within the partitions, then Arrow batches. A row with a null
    key is a series of its own. Rows with a null order value come first in their series (NaN).
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    keys = list(keys)

    def emit(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        out = kernel(Block(pa.concat_tables(tables).combine_chunks(), keys))
        arrays = [_column(out[f.name], f.type) for f in arrow]
        yield from pa.Table.from_arrays(arrays, schema=arrow).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < target_rows:
                continue
            cut = _last_start(held[-1], keys)
            if cut is None:  # the batch holds one series only; the series before it may be whole
                continue
            whole = [*held[:-1], held[-1].slice(0, cut)]
            held = [held[-1].slice(cut)]
            rows = held[0].num_rows
            yield from emit(whole)
        if held:
            yield from emit(held)

    # By number, partitions are not put together: for kernels that compute much on few rows.
    spread = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    ordered = spread.sortWithinPartitions(*keys, order)
    return ordered.mapInArrow(run, schema)


def merged(parts: Sequence[DataFrame], keys: Sequence[str] = SERIES) -> DataFrame:
    """Partial results put together by series: a row for each series of any part, null where a part lacks it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full")
    return out


def _column(v: np.ndarray | pa.ChunkedArray, kind: pa.DataType) -> pa.Array | pa.ChunkedArray:
    if isinstance(v, pa.ChunkedArray):
        return v.cast(kind)
    return pa.array(v, type=kind, from_pandas=pa.types.is_floating(kind))


def _last_start(t: pa.Table, keys: Sequence[str]) -> int | None:
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return int(at[-1]) if len(at) else None
