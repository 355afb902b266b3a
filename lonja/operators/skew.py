"""Joins whose keys may be skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is frequent: there are at most 1 / SHARE such keys.
SHARE = 1 / 4096


def join_counted(rows: DataFrame, table: DataFrame, on: Sequence[str], count: str = "n", fits: Column | None = None, share: float = SHARE) -> DataFrame:
    """Inner join of `rows` with `table`, which has each key once and the number of its rows in `count`.

    Keys with at least `share` of the rows meet them by broadcast: there can be no more than
    1 / share of them, so the size of that side has a bound whatever the data are. `fits` narrows
    them further, where the size of a key or its values varies. All other keys, of which none has a
    large share, join by a shuffle. Both inputs are read more than once and should be tables.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) >= max(1.0, total * share)
    if fits is not None:
        frequent = frequent & F.coalesce(fits, F.lit(False))
    head = table.where(frequent).drop(count)
    tail = table.where(~frequent).drop(count)
    on = list(on)
    common = rows.join(F.broadcast(head), on)
    rare = rows.join(F.broadcast(head.select(*on)), on, "left_anti").join(tail, on)
    return common.unionByName(rare)
