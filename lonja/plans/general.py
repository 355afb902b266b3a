"""Queries of the general data problems (p1 to p4, p6, p7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.operators.drift import drift, unify
from lonja.operators.grid import regular
from lonja.operators.impute import Field, fill
from lonja.operators.rolling import rolling
from lonja.operators.series import SERIES, Block, has_value, holding_rows, map_series
from lonja.operators.spikes import implausible
from lonja.operators.units import ScaleModel, converted, known_units, reference_levels, with_unit
from lonja.operators.usable import MASS, PRICE
from lonja.session import table, written

KEY = (*SERIES, "fecha")


def day() -> Column:
    """The date as text, as results give it."""
    return F.date_format("fecha", "yyyy-MM-dd").alias("fecha")


def holding(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return holding_rows(table(spark, sf_dir, "precios_diarios"), KEY, "cargado_en", columns)


# -- p1: missing values -----------------------------------------------------------------------

MASSES = [Field("masa_hoy", MASS, "masa", 0.1), Field("masa_ayer", MASS, "masa", 0.1), Field("masa_hoy", MASS, "masa", 0.1, -1), Field("masa_ayer", MASS, "masa", 0.1, 1)]
PRICES = [Field("precio_ayer_kg", PRICE, "precio"), Field("precio_hoy_kg", PRICE, "precio"), Field("precio_hoy_kg", PRICE, "precio", 0, -1)]
TARGETS = ("masa_hoy", "masa_ayer", "precio_ayer_kg")


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding rows with every unusable mass, previous mass, previous price and trend filled and marked."""
    rows = holding(spark, sf_dir, *TARGETS, "precio_hoy_kg", "tendencia")
    return fill(rows, [*MASSES, *PRICES], TARGETS, "tendencia")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that were filled."""
    rows = holding(spark, sf_dir, *TARGETS, "precio_hoy_kg")
    filled = fill(rows, [*MASSES, *PRICES], TARGETS)
    campos = F.array_compact(F.array(*[F.when(F.col(f"{c}_relleno"), F.lit(c)) for c in TARGETS]))
    return filled.select(*SERIES, day(), F.explode(campos).alias("campo"))


# -- p2: units, p4: implausible prices ----------------------------------------------------------


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding rows with the published unit in kilograms and the product's reference level."""
    held = holding(spark, sf_dir, "precio_hoy_unit", "precio_hoy_kg", "unidad")
    held = written(with_unit(held, table(spark, sf_dir, "unidades"), table(spark, sf_dir, "productos")).drop("unidad"), "units")
    levels = reference_levels(held)
    held = held.join(levels, held["producto_id"].eqNullSafe(levels["_anchor_of"]), "left").drop("_anchor_of")
    return held.withColumn("_hundredths", F.coalesce("_hundredths", F.lit(False)))


def _price_kernel(b: Block, model: ScaleModel) -> dict:
    price, state, kg = converted(b, model=model)
    stored, published = b["precio_hoy_kg"], b["precio_hoy_unit"]
    with np.errstate(invalid="ignore"):
        off = ~np.isnan(published) & (np.isnan(stored) | (np.abs(stored - price) > 0.02 * np.abs(price)))
    price = np.where(np.isnan(price), stored / np.exp(model.offsets)[state], price)
    out = {"equiv_kg": kg, "precio_kg": price, "escala": state, "corregido": off, "marca": implausible(price, b.series)}
    return out | {k: b.columns.column(k) for k in KEY}


_PRICES = "producto_id int, mercado_id int, fecha date, equiv_kg double, precio_kg double, escala int, corregido boolean, marca int"


def p2_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holding rows with `equiv_kg` in kilograms, the price in soles per kilogram, the decoded money scale
    (0: what the text says, 1: hundredths), whether the stored price had to be corrected, and the p4 mark."""
    model = ScaleModel(units=known_units(table(spark, sf_dir, "unidades")))
    return map_series(_priced(spark, sf_dir), lambda b: _price_kernel(b, model), _PRICES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_converted(spark, sf_dir).where("corregido").select(*SERIES, day())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_converted(spark, sf_dir).where("marca > 0").select(*SERIES, day())


# -- p3: trailing periods ---------------------------------------------------------------------


def _p3(spark: SparkSession, sf_dir: str, windows: tuple[int, ...]) -> DataFrame:
    rows = holding(spark, sf_dir, "masa_hoy", "precio_hoy_kg", "masa_7d", "precio_7d_kg")
    rows = rows.withColumn("masa_mala", ~MASS.usable("masa_hoy"))
    return rolling(rows, totals=["masa_hoy"], means=["precio_hoy_kg"], windows=windows, carry=["masa_7d", "precio_7d_kg"], unusable={"masa_sin_uso": "masa_mala"})


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and means of the last 7 and 30 days for each series and calendar day."""
    r = _p3(spark, sf_dir, (7, 30))
    names = [f"masa_hoy_{x}_{w}" for w in (7, 30) for x in ("total", "media")] + [f"precio_hoy_kg_media_{w}" for w in (7, 30)]
    return r.select(*SERIES, day(), F.col("con_fila"), *names)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded trailing means that contradict the recomputed ones."""
    r = _p3(spark, sf_dir, (7,)).where((F.col("con_fila") == 1) & (F.col("dias") >= 6))

    def contradicts(recorded: str, computed: str):
        off = F.abs(F.col(recorded) - F.col(computed))
        return has_value(recorded) & (off > 0.03 * F.abs(F.col(computed))) & (off > 0.01)

    campos = F.array_compact(
        F.array(
            F.when((F.col("masa_sin_uso_7") == 0) & contradicts("masa_7d", "masa_hoy_media_7"), F.lit("masa_7d")),
            F.when((F.col("precio_hoy_kg_n_7") > 0) & contradicts("precio_7d_kg", "precio_hoy_kg_media_7"), F.lit("precio_7d_kg")),
        )
    )
    return r.select(*SERIES, day(), F.explode(campos).alias("campo"))


# -- p6: regular grid -------------------------------------------------------------------------


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each series on each day of its market, with the days lacking one filled and marked."""
    grid = regular(holding(spark, sf_dir, "precio_hoy_kg"), "precio_hoy_kg")
    return grid.withColumn("precio_hoy_kg", F.round("precio_hoy_kg", 6))  # sums and differences of the counter leave traces


def p6_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of each user's value in cents, read on the days of its events and set to 0 every Monday, on all days."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    daily = e.groupBy("user_id", F.to_date("ts").alias("fecha")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("v"))
    week = Window.partitionBy("user_id", F.trunc("fecha", "week")).orderBy("fecha").rowsBetween(Window.unboundedPreceding, 0)
    read = daily.select("user_id", "fecha", F.sum("v").over(week).alias("cuenta"), F.lit(1).alias("origen"))
    grid = regular(read, "cuenta", keys=["user_id"], source="origen", kind="counter")
    return grid.select("user_id", day(), F.round("cuenta", 6).alias("aumento"), "sin_lectura")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the grid without a reading of their own."""
    return p6_grid(spark, sf_dir).where("sin_lectura").select(*SERIES, day())


# -- p7: drifting schemas ----------------------------------------------------------------------


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a report's fields against the report of its source before it."""
    return drift(table(spark, sf_dir, "reportes")).select("reporte_id", "campo", "cambio")


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports' rows as one table of consistent fields."""
    reports = table(spark, sf_dir, "reportes")
    return unify(reports, drift(reports))


QUERIES = {"p7_found": p7_found, "p7_unified": p7_unified, "p6_grid": p6_grid, "p6_counter": p6_counter, "p6_found": p6_found, "p2_converted": p2_converted, "p2_found": p2_found, "p4_found": p4_found, "p1_filled": p1_filled, "p1_found": p1_found, "p3_rolling": p3_rolling, "p3_found": p3_found}

#: Holding rows, in SQL.
H = """h AS (SELECT * FROM precios_diarios WHERE producto_id IS NOT NULL AND mercado_id IS NOT NULL AND fecha IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id, fecha ORDER BY cargado_en DESC NULLS LAST) = 1)"""

_GRID = """lim AS (SELECT producto_id, mercado_id, min(fecha) AS f0, max(fecha) AS f1 FROM h GROUP BY ALL),
 g AS (SELECT producto_id, mercado_id, f0, CAST(unnest(generate_series(CAST(f0 AS TIMESTAMP), CAST(f1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS fecha FROM lim),
 v AS (SELECT g.producto_id, g.mercado_id, g.fecha, g.f0, h.fecha IS NOT NULL AS con,
  CASE WHEN isnan(h.masa_hoy) THEN NULL ELSE h.masa_hoy END AS m, CASE WHEN isnan(h.precio_hoy_kg) THEN NULL ELSE h.precio_hoy_kg END AS p, h.masa_7d, h.precio_7d_kg,
  CASE WHEN h.fecha IS NOT NULL AND NOT coalesce(NOT isnan(h.masa_hoy) AND h.masa_hoy >= 0 AND h.masa_hoy < 5000, FALSE) THEN 1 ELSE 0 END AS mala
  FROM g LEFT JOIN h USING (producto_id, mercado_id, fecha)),
 s AS (SELECT *, {sums} FROM v WINDOW w7 AS (PARTITION BY producto_id, mercado_id ORDER BY fecha ROWS 6 PRECEDING), w30 AS (PARTITION BY producto_id, mercado_id ORDER BY fecha ROWS 29 PRECEDING))"""
_SUMS = ", ".join(f"coalesce(sum(round_even(m * 1e6, 0)) OVER w{w}, 0) / 1e6 AS m{w}, sum(round_even(p * 1e6, 0)) OVER w{w} / 1e6 / count(p) OVER w{w} AS p{w}, sum(mala) OVER w{w} AS mala{w}" for w in (7, 30))
_GRID = _GRID.replace("{sums}", _SUMS)

SQL = {
    "p6_grid": f"""WITH {H}, lim AS (SELECT producto_id, mercado_id, min(fecha) AS f0, max(fecha) AS f1, min(fecha) FILTER (precio_hoy_kg IS NOT NULL AND NOT isnan(precio_hoy_kg)) AS r0 FROM h GROUP BY ALL), d AS (SELECT DISTINCT mercado_id, fecha FROM h),
 v AS (SELECT lim.producto_id, lim.mercado_id, d.fecha, r0, CASE WHEN isnan(h.precio_hoy_kg) THEN NULL ELSE h.precio_hoy_kg END AS p FROM lim JOIN d ON d.mercado_id = lim.mercado_id AND d.fecha BETWEEN f0 AND f1 LEFT JOIN h ON h.producto_id = lim.producto_id AND h.mercado_id = lim.mercado_id AND h.fecha = d.fecha)
 SELECT producto_id, mercado_id, fecha, CASE WHEN fecha >= r0 THEN round(first_value(p IGNORE NULLS) OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) END AS precio_hoy_kg, p IS NULL AS sin_lectura FROM v""",
    "p6_counter": """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS fecha, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
 c AS (SELECT user_id, fecha, sum(v) OVER (PARTITION BY user_id, date_trunc('week', fecha) ORDER BY fecha) AS c FROM e), s AS (SELECT user_id, fecha, c, lag(c) OVER w AS c0, lag(fecha) OVER w AS f0 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY fecha)),
 d AS (SELECT DISTINCT fecha FROM c), lim AS (SELECT user_id, min(fecha) AS a, max(fecha) AS z FROM c GROUP BY user_id)
 SELECT lim.user_id, strftime(d.fecha, '%Y-%m-%d') AS fecha, round(CAST(CASE WHEN s.c < s.c0 THEN s.c ELSE s.c - s.c0 END AS DOUBLE) / CAST(s.fecha - s.f0 AS DOUBLE), 6) AS aumento, c.c IS NULL AS sin_lectura
 FROM lim JOIN d ON d.fecha BETWEEN a AND z LEFT JOIN s ON s.user_id = lim.user_id AND d.fecha > s.f0 AND d.fecha <= s.fecha LEFT JOIN c ON c.user_id = lim.user_id AND c.fecha = d.fecha""",
    "p6_found": f"""WITH {H}, lim AS (SELECT producto_id, mercado_id, min(fecha) AS f0, max(fecha) AS f1 FROM h GROUP BY ALL), d AS (SELECT DISTINCT mercado_id, fecha FROM h)
 SELECT lim.producto_id, lim.mercado_id, strftime(d.fecha, '%Y-%m-%d') AS fecha FROM lim JOIN d ON d.mercado_id = lim.mercado_id AND d.fecha BETWEEN f0 AND f1
 LEFT JOIN h ON h.producto_id = lim.producto_id AND h.mercado_id = lim.mercado_id AND h.fecha = d.fecha WHERE h.precio_hoy_kg IS NULL OR isnan(h.precio_hoy_kg)""",
    "p1_found": f"""WITH {H}, c AS (SELECT producto_id, mercado_id, strftime(fecha, '%Y-%m-%d') AS fecha, unnest([
  {{'c': 'masa_hoy', 'ok': NOT isnan(masa_hoy) AND masa_hoy >= 0 AND masa_hoy < 5000}}, {{'c': 'masa_ayer', 'ok': NOT isnan(masa_ayer) AND masa_ayer >= 0 AND masa_ayer < 5000}},
  {{'c': 'precio_ayer_kg', 'ok': NOT isnan(precio_ayer_kg) AND precio_ayer_kg > 0 AND precio_ayer_kg < 500000}}]) AS u FROM h)
 SELECT producto_id, mercado_id, fecha, u.c AS campo FROM c WHERE NOT coalesce(u.ok, FALSE)""",
    "p3_rolling": f"""WITH {H}, {_GRID} SELECT producto_id, mercado_id, strftime(fecha, '%Y-%m-%d') AS fecha, CAST(con AS BIGINT) AS con_fila,
 m7 AS masa_hoy_total_7, m7 / 7 AS masa_hoy_media_7, m30 AS masa_hoy_total_30, m30 / 30 AS masa_hoy_media_30, p7 AS precio_hoy_kg_media_7, p30 AS precio_hoy_kg_media_30 FROM s""",
    "p3_found": f"""WITH {H}, {_GRID}, j AS (SELECT * FROM s WHERE con AND fecha >= f0 + 6)
 SELECT producto_id, mercado_id, strftime(fecha, '%Y-%m-%d') AS fecha, 'masa_7d' AS campo FROM j
 WHERE mala7 = 0 AND NOT isnan(masa_7d) AND abs(masa_7d - m7 / 7) > 0.03 * abs(m7 / 7) AND abs(masa_7d - m7 / 7) > 0.01
 UNION ALL SELECT producto_id, mercado_id, strftime(fecha, '%Y-%m-%d'), 'precio_7d_kg' FROM j
 WHERE p7 IS NOT NULL AND NOT isnan(precio_7d_kg) AND abs(precio_7d_kg - p7) > 0.03 * abs(p7) AND abs(precio_7d_kg - p7) > 0.01""",
}
