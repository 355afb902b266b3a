"""Joins that equality alone does not express."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.series import Block, map_series


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], order: str, values: Sequence[str], strict: bool = False, tile: str = "month") -> DataFrame:
    """left with, for each row, the `values` of the last row of right not after it (before it, if strict).

    `{order}_asof` is that row's date. Both sides fall into tiles of time, so a key with any share of
    the rows is spread over its tiles; the first rows of a tile take what the tiles before ended with,
    which is one row for each key and tile. Several right rows of one date: the greatest values.
    Null keys or dates match nothing. Rows of left are kept, repeated ones too.
    """
    on = list(on)
    seen = F.struct(F.col(order).alias("_at"), *values)
    right = right.where(F.col(order).isNotNull()).groupBy(*on, order).agg(F.max(F.struct(*values)).alias("_x")).select(*on, order, *[F.col("_x")[v].alias(v) for v in values])
    r = right.select(*on, F.trunc(order, tile).alias("_tile"), F.col(order).alias("_o"), F.lit(1 if strict else 0).alias("_side"), seen.alias("_r"), F.lit(None).cast(left.schema).alias("_l"))
    kept = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*on, F.trunc(order, tile).alias("_tile"), F.col(order).alias("_o"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), kept.alias("_l"))
    within = Window.partitionBy(*on, "_tile").orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = r.unionByName(l).withColumn("_near", F.last("_r", ignorenulls=True).over(within)).where(F.col("_l").isNotNull())
    ends = right.groupBy(*on, F.trunc(order, tile).alias("_tile")).agg(F.max(seen).alias("_end"))
    # Tiles that left needs, with the last end before each.
    need = left.select(*on, F.trunc(order, tile).alias("_tile")).distinct()
    tiles = need.join(ends, [*on, "_tile"], "full").withColumn("_far", F.last("_end", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)))
    out = near.join(tiles.select(*on, "_tile", "_far"), [*on, "_tile"], "left")
    got = F.coalesce("_near", "_far")
    missing = F.col("_o").isNull()
    return out.select("_l.*", F.when(~missing, got["_at"]).alias(f"{order}_asof"), *[F.when(~missing, got[v]).alias(f"{v}_asof") for v in values])


def within(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str, tile: str = "month") -> DataFrame:
    """Pairs of a point and a span that holds it: equal `on`, start <= at <= end.

    Spans are laid out over the tiles of time that they touch and points fall into one, so the join
    is one of equality; a null bound, date or key matches nothing.
    """
    on = list(on)
    laid = spans.where(F.col(start) <= F.col(end)).withColumn("_tile", F.explode(F.sequence(F.trunc(start, tile), F.trunc(end, tile), F.expr(f"interval 1 {tile}"))))
    return points.withColumn("_tile", F.trunc(at, tile)).join(laid, [*on, "_tile"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_tile")


def correlations(df: DataFrame, group: str, order: str, member: str, value: str, least: int = 30) -> DataFrame:
    """group, a, b, n, r: Pearson correlation of each two members of a group over their common dates.

    value holds whole numbers. No pairs of rows are made: for each group and month the members' values
    are the columns of a matrix, and products of such matrices give the sums for all pairs at once;
    the months add up. Members are those of a dimension, of which a group holds a bounded number.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull() & F.col(member).isNotNull() & F.col(group).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(group), F.trunc(order, "month").alias("_tile"), F.col(order), F.col(member), F.col(value).cast("double").alias("_v"))

    def kernel(b: Block) -> dict[str, np.ndarray]:
        names = ("n", "sa", "sb", "saa", "sbb", "sab")
        out: dict[str, list[np.ndarray]] = {k: [] for k in (group, "a", "b", *names)}
        for s, e in zip(b.starts, b.ends):
            who, col = np.unique(b[member][s:e], return_inverse=True)
            when, row = np.unique(b[order][s:e], return_inverse=True)
            x = np.zeros((len(when), len(who)))
            there = np.zeros_like(x)
            x[row, col], there[row, col] = b["_v"][s:e], 1
            sums = (there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x)
            i, j = np.triu_indices(len(who), 1)
            keep = sums[0][i, j] > 0
            i, j = i[keep], j[keep]
            out[group].append(np.full(len(i), b[group][s]))
            out["a"].append(who[i])
            out["b"].append(who[j])
            for k, m in zip(names, sums):
                out[k].append(m[i, j].astype(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()}

    schema = f"{group} {kinds[group]}, a {kinds[member]}, b {kinds[member]}, " + ", ".join(f"{k} bigint" for k in ("n", "sa", "sb", "saa", "sbb", "sab"))
    part = map_series(rows, kernel, schema, keys=[group, "_tile"], order=order)
    total = part.groupBy(group, "a", "b").agg(*[F.sum(k).cast("double").alias(k) for k in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n, sa, sb, saa, sbb, sab = (F.col(k) for k in ("n", "sa", "sb", "saa", "sbb", "sab"))
    bottom = F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))
    return total.where(n >= least).select(group, "a", "b", n.cast("bigint").alias("n"), F.try_divide(n * sab - sa * sb, bottom).alias("r"))


def in_order(asked: DataFrame, known: DataFrame, query: str, place: str, on: str, values: Sequence[str], most: int) -> DataFrame:
    """query, values, lugar: what each query's list (query, place, on) names, in the order of the list.

    Unknown names drop out, repeated ones count at their first place, and `most` are kept of each list.
    """
    found = asked.join(known.select(on, *values), on).groupBy(query, *values).agg(F.min(place).alias("_i"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("_i"))
    return found.withColumn("lugar", rank).where(F.col("lugar") <= most).drop("_i")
