"""The best model of each series with its forecast, and the comparison of families of models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.boosting import LEAST, refitted
from lonja.operators.series import SERIES

#: What a forecast is chosen from, the first of equals, and the families that are compared.
CHOICE = ("estacional", "tendencia", "gbm")
FAMILIES = ("baseline", "ar1", "volumen", "gbm")


def forecasted(df: DataFrame, value: str, volume: str, ahead: int | Sequence[int] = 1, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """keys, h, metodo, punto, desde, hasta, mae, mae_base, n: a forecast `ahead` steps after the last value.

    The model of the least mean error; punto in whole units of value, between desde and hasta by one
    deviation of its errors. `sin_datos` for fewer than 90 values, `naive` where no model can be judged:
    the last value (0 without any), without errors. Of several ahead each is a row.
    """
    aheads = (ahead,) if isinstance(ahead, int) else tuple(ahead)
    made = refitted(df, value, volume, aheads, rows=60, models=CHOICE, keys=keys, order=order, final=True)
    place = F.array_position(F.array(*map(F.lit, CHOICE)), F.col("metodo"))
    best = made.groupBy(*keys, "h").agg(F.min(F.struct("mae", place.alias("_k"), "metodo", "punto", "sigma")).alias("_b"), F.max(F.when(F.col("metodo") == "estacional", F.col("mae"))).alias("mae_base"))
    there = F.when(F.col(value).isNotNull(), F.col(order))
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, order)]))
    series = known.groupBy(*keys).agg(F.count(value).alias("n"), F.coalesce(F.max_by(value, there), F.lit(0)).alias("_y"))
    rows = series.withColumn("h", F.explode(F.array(*map(F.lit, aheads)))).join(best, [*keys, "h"], "left")
    whole = lambda c: F.floor(c + 0.5).cast("bigint")
    point = F.coalesce(whole(F.col("_b.punto")), F.col("_y"))
    spread = F.coalesce(F.col("_b.sigma"), F.lit(0.0))
    none = F.when(F.col("n") < LEAST["estacional"], "sin_datos").otherwise("naive")
    return rows.select(*keys, "h", F.coalesce("_b.metodo", none).alias("metodo"), point.alias("punto"), whole(F.greatest(point - spread, F.lit(0.0))).alias("desde"), whole(point + spread).alias("hasta"), F.col("_b.mae").alias("mae"), "mae_base", "n")


def compared(df: DataFrame, value: str, volume: str, ahead: int = 1, keys: Sequence[str] = SERIES, order: str = "fecha") -> DataFrame:
    """h, familia, series, mae, mejora, rango, series_comun, mae_comun, gana: families of models side by side.

    baseline is the better of estacional and tendencia of each series. series, mae: where the family can
    be judged; mejora: per cent below the baseline's mae; rango: by mae. series_comun, mae_comun: on the
    series that gbm is judged on, or all where it is on none; gana: has the least mae_comun.
    """
    made = refitted(df, value, volume, ahead, rows=60, models=(*CHOICE, "ar1", "ar1_volumen"), keys=keys, order=order)
    of = lambda m: F.max(F.when(F.col("metodo") == m, F.col("mae")))
    wide = made.groupBy(*keys).agg(F.least(of("estacional"), of("tendencia")).alias("baseline"), of("ar1").alias("ar1"), of("ar1_volumen").alias("volumen"), of("gbm").alias("gbm")).where("baseline IS NOT NULL")
    common = {f"_{f}": F.when(F.col("gbm").isNotNull(), F.col(f)) for f in FAMILIES}
    own = wide.withColumns(common).agg(*[a for f in FAMILIES for a in (F.count(f).alias(f"{f}_n"), F.avg(f).alias(f"{f}_m"), F.count(f"_{f}").alias(f"{f}_cn"), F.avg(f"_{f}").alias(f"{f}_cm"))])
    alone = F.col("gbm_n") == 0
    structs = [F.struct(F.lit(i).alias("_i"), F.lit(f).alias("familia"), F.col(f"{f}_n").alias("series"), F.col(f"{f}_m").alias("mae"), F.when(alone, F.col(f"{f}_n")).otherwise(F.col(f"{f}_cn")).alias("series_comun"), F.when(alone, F.col(f"{f}_m")).otherwise(F.col(f"{f}_cm")).alias("mae_comun")) for i, f in enumerate(FAMILIES)]
    flat = own.select(F.col("baseline_m").alias("_base"), F.explode(F.array(*structs)).alias("x")).select("_base", "x.*").where("series > 0")
    one = Window.partitionBy(F.lit(ahead))  # four rows
    better = F.try_divide(F.col("_base") - F.col("mae"), F.col("_base")) * 100
    out = flat.withColumns({"h": F.lit(ahead), "mejora": better, "rango": F.row_number().over(one.orderBy("mae", "_i")), "_w": F.row_number().over(one.orderBy(F.asc_nulls_last("mae_comun"), "_i"))})
    return out.select("h", "familia", "series", "mae", "mejora", "rango", "series_comun", "mae_comun", (F.col("_w") == 1).alias("gana"))
