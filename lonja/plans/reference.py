"""Queries of the price analytics: series, rankings, calendars, joins, retrieval.

Prices are whole numbers of 1/10,000 soles (`p`), masses of 1/100 tonnes (`m`), so that sums do not
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions import vectors as vec
from lonja.functions.calendar import FIXED, MONTHS, WEEKDAYS, holidays, long_date, long_date_of, period
from lonja.functions.questions import date_range, mentions, numbers
from lonja.functions.text import normalised, slug, tokens
from lonja.operators import joins, retrieval, windows
from lonja.operators.boosting import refitted
from lonja.operators.series import SERIES, holding_rows
from lonja.operators.usable import MASS, Range
from lonja.plans.general import KEY, H
from lonja.session import table
from lonja.sources.store import insert_new

#: Soles a kilogram of a plausible price.
SOLES = Range(0, 200, open=True)


def ticks(c: str, scale: float, rule: Range) -> Column:
    return F.when(rule.usable(c), F.floor(F.col(c) * scale + 0.5).cast("bigint"))


def px(spark: SparkSession, d: str) -> DataFrame:
    """Holding rows: producto_id, mercado_id, fecha, p, m, tendencia; keys and date are not null."""
    rows = table(spark, d, "precios_diarios").where("producto_id IS NOT NULL AND mercado_id IS NOT NULL AND fecha IS NOT NULL")
    return holding_rows(rows, KEY, "cargado_en", [ticks("precio_hoy_kg", 1e4, SOLES).alias("p"), ticks("masa_hoy", 100, MASS).alias("m"), F.col("tendencia")])


PX = f"""{H}, px AS (SELECT producto_id, mercado_id, fecha, CASE WHEN precio_hoy_kg > 0 AND precio_hoy_kg < 200 THEN CAST(floor(precio_hoy_kg * 1e4 + 0.5) AS BIGINT) END AS p,
 CASE WHEN masa_hoy >= 0 AND masa_hoy < 5000 THEN CAST(floor(masa_hoy * 100 + 0.5) AS BIGINT) END AS m, tendencia FROM h)"""
W = "PARTITION BY producto_id, mercado_id ORDER BY fecha"

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- sources and upserts ------------------------------------------------------------------------


@query("s16_upserted_prices", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p, m, tendencia FROM px")
def _(spark, d):
    return px(spark, d)


@query(
    "s18_new_sources",
    """WITH k AS (SELECT DISTINCT fuente, sha256 FROM fuentes_raw WHERE fecha IS NULL), r AS (SELECT fuente, sha256, min(id) AS id FROM fuentes_raw WHERE fecha IS NOT NULL GROUP BY ALL)
 SELECT r.fuente, r.sha256, r.id FROM r ANTI JOIN k ON r.fuente = k.fuente AND r.sha256 = k.sha256""",
)
def _(spark, d):
    raw = table(spark, d, "fuentes_raw")
    return insert_new(raw.where("fecha IS NULL"), raw.where("fecha IS NOT NULL").select("fuente", "sha256", "id"), ["fuente", "sha256"])


@query("s19_counts", f"WITH {PX} SELECT mercado_id, count(*) AS filas, count(DISTINCT fecha) AS fechas, count(DISTINCT producto_id) AS productos FROM px GROUP BY mercado_id")
def _(spark, d):
    return px(spark, d).groupBy("mercado_id").agg(F.count("*").alias("filas"), F.countDistinct("fecha").alias("fechas"), F.countDistinct("producto_id").alias("productos"))


@query(
    "s22_other_markets",
    f"""WITH {PX}, c AS (SELECT *, last_value(p IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, max(fecha) OVER (PARTITION BY mercado_id) AS f1 FROM px)
 SELECT c.mercado_id, c.producto_id, fecha, p, CAST(p - q AS DOUBLE) / q AS var FROM c JOIN mercados ON mercados.id = c.mercado_id WHERE fecha = f1 AND codigo <> 'GMML'""",
)
def _(spark, d):
    rows = px(spark, d).withColumns({"var": windows.change("p"), "_last": F.max("fecha").over(Window.partitionBy("mercado_id"))})
    markets = table(spark, d, "mercados").where("codigo <> 'GMML'").select(F.col("id").alias("mercado_id"))
    return rows.where("fecha = _last").join(markets, "mercado_id").select("mercado_id", "producto_id", "fecha", "p", "var")


@query("s43_product_pages", "SELECT id, concat('/p/', trim(lower(regexp_replace(strip_accents(nombre_canonico), '[^a-zA-Z0-9]+', '-', 'g')), '-')) AS ruta FROM productos")
def _(spark, d):
    return table(spark, d, "productos").select("id", F.concat(F.lit("/p/"), slug("nombre_canonico")).alias("ruta"))


# -- cleaning and scalar functions --------------------------------------------------------------


@query("c05_decimal_marks", r"SELECT unidad, TRY_CAST(replace(nullif(regexp_extract(unidad, '[0-9]+([.,][0-9]+)?'), ''), ',', '.') AS DOUBLE) AS numero FROM (SELECT DISTINCT unidad FROM precios_diarios)")
def _(spark, d):
    number = F.regexp_replace(F.nullif(F.regexp_extract("unidad", r"[0-9]+([.,][0-9]+)?", 0), F.lit("")), ",", ".").try_cast("double")
    return table(spark, d, "precios_diarios").select("unidad").distinct().select("unidad", number.alias("numero"))


@query("c15_first_of_each", "SELECT fuente, fecha, min(reporte_id) AS reporte_id FROM reportes GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "reportes").groupBy("fuente", "fecha").agg(F.min("reporte_id").alias("reporte_id"))


@query("c17_gate", "SELECT DISTINCT reporte_id, n_filas, (fecha IS NOT NULL AND n_filas >= 8) AS pasa, list_contains(warnings, 'fecha ilegible') AS ilegible FROM reportes")
def _(spark, d):
    ok = F.col("fecha").isNotNull() & (F.col("n_filas") >= 8)
    return table(spark, d, "reportes").select("reporte_id", "n_filas", ok.alias("pasa"), F.array_contains("warnings", "fecha ilegible").alias("ilegible")).distinct()


@query(
    "c19_targets",
    "SELECT fuente, fecha FROM (SELECT fuente, fecha, dense_rank() OVER (PARTITION BY fuente ORDER BY year(fecha) * 12 + month(fecha) DESC) AS k FROM (SELECT DISTINCT fuente, fecha FROM reportes WHERE fecha IS NOT NULL)) WHERE k <= 2",
)
def _(spark, d):
    rows = table(spark, d, "reportes").where("fecha IS NOT NULL").select("fuente", "fecha").distinct()
    rank = F.dense_rank().over(Window.partitionBy("fuente").orderBy(F.desc(F.year("fecha") * 12 + F.month("fecha"))))
    return rows.withColumn("k", rank).where("k <= 2").drop("k")


@query(
    "f02_names",
    """SELECT id, trim(lower(regexp_replace(strip_accents(nombre_canonico), '[^a-zA-Z0-9]+', '-', 'g')), '-') AS slug, lower(strip_accents(nombre_canonico)) AS llano,
 array_to_string(list_filter(string_split_regex(lower(strip_accents(nombre_canonico)), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS palabras FROM productos""",
)
def _(spark, d):
    return table(spark, d, "productos").select("id", slug("nombre_canonico").alias("slug"), normalised("nombre_canonico").alias("llano"), F.array_join(tokens("nombre_canonico"), " ").alias("palabras"))


def _sql_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(
    "f10_long_dates",
    f"""SELECT fecha, concat({_sql_list(WEEKDAYS)}[isodow(fecha)], ' ', day(fecha), ' de ', {_sql_list(MONTHS)}[month(fecha)], ' de ', year(fecha)) AS larga, fecha AS leida
 FROM (SELECT DISTINCT fecha FROM precios_diarios)""",
)
def _(spark, d):
    rows = table(spark, d, "precios_diarios").select("fecha").distinct().withColumn("larga", long_date("fecha"))
    return rows.withColumn("leida", long_date_of("larga"))


@query("f11_periods", "SELECT DISTINCT fecha, strftime(fecha, '%Y-%m-%d') AS dia, printf('%d-W%02d', isoyear(fecha), week(fecha)) AS semana, strftime(fecha, '%Y-%m') AS mes FROM precios_diarios")
def _(spark, d):
    return table(spark, d, "precios_diarios").select("fecha").distinct().select("fecha", *[period("fecha", g).alias(g) for g in ("dia", "semana", "mes")])


#: The holidays of the years of the data, by another rule for Easter than the calendar's.
_OFF = """k AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(range(CAST((SELECT min(year(fecha)) FROM f) AS BIGINT), CAST((SELECT max(year(fecha)) FROM f) AS BIGINT) + 1)) AS y)),
 k2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM k), k3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM k2), k4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM k3),
 p AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS d FROM k4), o AS (SELECT list(d) AS o FROM (SELECT d - 3 AS d FROM p UNION ALL SELECT d - 2 FROM p UNION ALL SELECT make_date(y, m, t) FROM k, (VALUES """ + ", ".join(f"({m}, {t})" for m, t in FIXED) + """) v(m, t)))"""


@query(
    "f14_business_days",
    f"""WITH f AS (SELECT DISTINCT fecha FROM precios_diarios WHERE fecha IS NOT NULL), u AS (SELECT max(fecha) AS hoy FROM f), {_OFF}
 SELECT fecha, list_contains(o, fecha) AS feriado, len(list_filter(range(1, CAST(hoy - fecha AS BIGINT) + 1), lambda i: isodow(fecha + CAST(i AS INTEGER)) < 6 AND NOT list_contains(o, fecha + CAST(i AS INTEGER)))) AS habiles FROM f, u, o""",
)
def _(spark, d):
    days = table(spark, d, "precios_diarios").where("fecha IS NOT NULL").select("fecha").distinct()
    ends = days.agg(F.min("fecha").alias("a"), F.max("fecha").alias("hoy"))  # one row
    span = ends.first()
    known = holidays(span.a.year, span.hoy.year) if span.a else []  # of every year of the data
    off = F.array(*[F.lit(x) for x in known]).cast("array<date>")
    rows = days.crossJoin(F.broadcast(ends.select("hoy")))
    later = F.when(F.col("fecha") < F.col("hoy"), F.sequence(F.date_add("fecha", 1), F.col("hoy"))).otherwise(F.array().cast("array<date>"))
    open_days = F.filter(later, lambda x: (F.weekday(x) < 5) & ~F.array_contains(off, x))
    return rows.select("fecha", F.array_contains(off, F.col("fecha")).alias("feriado"), F.size(open_days).cast("bigint").alias("habiles"))


@query("f19_fingerprints", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS huella FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("huella"))


@query("f20_int8", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 127, 0))) AS INTEGER)), ' ') AS q FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(vec.quantised("embedding"), lambda x: x.cast("string")), " ").alias("q"))


# -- filters ------------------------------------------------------------------------------------

_FROM, _TO = "2024-06-01", "2024-08-31"


@query("l01_overlap", f"SELECT doc_id, tipo, slug FROM documents WHERE (fecha_fin IS NULL OR fecha_fin >= DATE '{_FROM}') AND (fecha_inicio IS NULL OR fecha_inicio <= DATE '{_TO}') AND tipo IN ('producto_periodo', 'evento_anomalia') AND slug IS NOT NULL")
def _(spark, d):
    inside = (F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= F.lit(_FROM).cast("date"))) & (F.col("fecha_inicio").isNull() | (F.col("fecha_inicio") <= F.lit(_TO).cast("date")))
    kinds = F.col("tipo").isin("producto_periodo", "evento_anomalia")
    return table(spark, d, "documents").where(inside & kinds & F.col("slug").isNotNull()).select("doc_id", "tipo", "slug")


@query("l04_search", "SELECT doc_id, producto FROM documents WHERE contains(lower(strip_accents(producto)), 'aji')")
def _(spark, d):
    return table(spark, d, "documents").where(F.contains(normalised("producto"), F.lit("aji"))).select("doc_id", "producto")


@query("l07_current_series", f"WITH {PX} SELECT producto_id, mercado_id FROM px GROUP BY ALL HAVING max(fecha) = (SELECT max(fecha) FROM px)")
def _(spark, d):
    last = px(spark, d).groupBy(*SERIES).agg(F.max("fecha").alias("f"))
    return last.join(F.broadcast(last.agg(F.max("f").alias("f"))), "f").select(*SERIES)  # one date


# -- joins --------------------------------------------------------------------------------------


@query(
    "j04_asof",
    f"""WITH {PX}, a AS (SELECT producto_id, fecha, p FROM px JOIN mercados ON id = mercado_id WHERE codigo = 'GMML' AND p IS NOT NULL), o AS (SELECT px.* FROM px JOIN mercados ON id = mercado_id WHERE codigo <> 'GMML')
 SELECT o.producto_id, o.mercado_id, o.fecha, o.p, a.fecha AS fecha_asof, a.p AS p_asof FROM o ASOF LEFT JOIN a ON o.producto_id = a.producto_id AND o.fecha >= a.fecha""",
)
def _(spark, d):
    rows = px(spark, d).join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")
    main = rows.where("codigo = 'GMML' AND p IS NOT NULL").select("producto_id", "fecha", "p")
    return joins.asof(rows.where("codigo <> 'GMML'").select(*KEY, "p"), main, ["producto_id"], "fecha", ["p"])


@query(
    "j05_cross_check",
    f"""WITH {PX}, a AS (SELECT producto_id, fecha, p AS g FROM px JOIN mercados ON id = mercado_id WHERE codigo = 'GMML' AND p IS NOT NULL)
 SELECT px.producto_id, px.mercado_id, px.fecha, CAST(p - g AS DOUBLE) / g AS delta, CASE WHEN g IS NULL THEN 'sin contraparte' WHEN abs(CAST(p - g AS DOUBLE) / g) > 0.15 THEN 'difiere' ELSE 'coincide' END AS estado
 FROM px JOIN mercados ON id = mercado_id LEFT JOIN a ON a.producto_id = px.producto_id AND a.fecha = px.fecha WHERE codigo <> 'GMML' AND p IS NOT NULL""",
)
def _(spark, d):
    rows = px(spark, d).where("p IS NOT NULL").join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")
    main = rows.where("codigo = 'GMML'").select("producto_id", "fecha", F.col("p").alias("g"))
    delta = F.try_divide((F.col("p") - F.col("g")).cast("double"), F.col("g").cast("double"))
    state = F.when(F.col("g").isNull(), "sin contraparte").when(F.abs(delta) > 0.15, "difiere").otherwise("coincide")
    return rows.where("codigo <> 'GMML'").join(main, ["producto_id", "fecha"], "left").select(*KEY, delta.alias("delta"), state.alias("estado"))


@query(
    "j07_prices_within_periods",
    f"""WITH {PX} SELECT doc_id, count(*) AS filas, min(p) AS minimo, max(p) AS maximo FROM documents JOIN productos ON nombre_canonico = producto JOIN mercados ON codigo = mercado
 JOIN px ON px.producto_id = productos.id AND px.mercado_id = mercados.id AND px.fecha BETWEEN fecha_inicio AND fecha_fin GROUP BY doc_id""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "producto", "mercado", "fecha_inicio", "fecha_fin")
    docs = docs.join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), F.col("nombre_canonico").alias("producto")), "producto")
    docs = docs.join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), F.col("codigo").alias("mercado")), "mercado")
    held = joins.within(px(spark, d).select(*KEY, "p"), docs, list(SERIES), "fecha", "fecha_inicio", "fecha_fin")
    return held.groupBy("doc_id").agg(F.count("*").alias("filas"), F.min("p").alias("minimo"), F.max("p").alias("maximo"))


_RETURNS = f"""r AS (SELECT producto_id, mercado_id, fecha, CAST(floor(CAST(p - q AS DOUBLE) / q * 1e6 + 0.5) AS BIGINT) AS v FROM (SELECT *, last_value(p IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM px) WHERE p IS NOT NULL AND q IS NOT NULL)"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    """v: change against the previous price, in millionths."""
    rows = px(spark, d).withColumn("v", windows.change("p")).where("p IS NOT NULL AND v IS NOT NULL")
    return rows.select(*KEY, F.floor(F.col("v") * 1e6 + 0.5).cast("bigint").alias("v"))


@query(
    "j10_correlations",
    f"""WITH {PX}, {_RETURNS}, s AS (SELECT x.mercado_id, x.producto_id AS a, y.producto_id AS b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x.v) AS DOUBLE) AS sa, CAST(sum(y.v) AS DOUBLE) AS sb, CAST(sum(x.v * x.v) AS DOUBLE) AS saa, CAST(sum(y.v * y.v) AS DOUBLE) AS sbb, CAST(sum(x.v * y.v) AS DOUBLE) AS sab
 FROM r x JOIN r y ON x.mercado_id = y.mercado_id AND x.fecha = y.fecha AND x.producto_id < y.producto_id GROUP BY ALL)
 SELECT mercado_id, a, b, CAST(n AS BIGINT) AS n, CASE WHEN sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) <> 0 THEN floor((n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) * 1e9 + 0.5) / 1e9 END AS r FROM s WHERE n >= 30""",
)
def _(spark, d):
    found = joins.correlations(returns(spark, d), "mercado_id", "fecha", "producto_id", "v")
    return found.withColumn("r", F.floor(F.col("r") * 1e9 + 0.5) / 1e9)


@query(
    "j12_catalog",
    "SELECT nombre, min(origen) AS origen FROM (SELECT lower(strip_accents(nombre_canonico)) AS nombre, '1 lista' AS origen FROM productos UNION ALL SELECT lower(strip_accents(producto)), '2 textos' FROM documents WHERE producto IS NOT NULL) GROUP BY nombre",
)
def _(spark, d):
    a = table(spark, d, "productos").select(normalised("nombre_canonico").alias("nombre"), F.lit("1 lista").alias("origen"))
    b = table(spark, d, "documents").where("producto IS NOT NULL").select(normalised("producto").alias("nombre"), F.lit("2 textos").alias("origen"))
    return a.unionByName(b).groupBy("nombre").agg(F.min("origen").alias("origen"))


# -- aggregations -------------------------------------------------------------------------------


@query(
    "a01_series_stats",
    f"""WITH {PX} SELECT producto_id, mercado_id, count(p) AS n, min(p) AS minimo, max(p) AS maximo, CAST(sum(p) AS DOUBLE) / count(p) AS media, arg_min(p, fecha) FILTER (p IS NOT NULL) AS primero, arg_max(p, fecha) FILTER (p IS NOT NULL) AS ultimo FROM px GROUP BY ALL""",
)
def _(spark, d):
    there = F.when(F.col("p").isNotNull(), F.col("fecha"))
    mean = F.try_divide(F.sum("p").cast("double"), F.count("p"))
    return px(spark, d).groupBy(*SERIES).agg(F.count("p").alias("n"), F.min("p").alias("minimo"), F.max("p").alias("maximo"), mean.alias("media"), F.min_by("p", there).alias("primero"), F.max_by("p", there).alias("ultimo"))


@query("a04_seasonality", f"WITH {PX} SELECT producto_id, month(fecha) AS mes, CAST(sum(p) AS DOUBLE) / count(p) AS media, count(DISTINCT year(fecha)) AS anios FROM px WHERE p IS NOT NULL GROUP BY ALL")
def _(spark, d):
    rows = px(spark, d).where("p IS NOT NULL").groupBy("producto_id", F.month("fecha").alias("mes"))
    return rows.agg((F.sum("p").cast("double") / F.count("p")).alias("media"), F.countDistinct(F.year("fecha")).alias("anios"))


@query(
    "a05_seasonal_deviation",
    f"""WITH {PX}, s AS (SELECT producto_id, mercado_id, month(fecha) AS mes, CAST(sum(p) AS DOUBLE) / count(p) AS media FROM px WHERE p IS NOT NULL GROUP BY ALL), l AS (SELECT * FROM px WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1)
 SELECT l.producto_id, l.mercado_id, l.fecha, l.p, (l.p - media) / media AS desvio FROM l JOIN s ON s.producto_id = l.producto_id AND s.mercado_id = l.mercado_id AND s.mes = month(l.fecha)""",
)
def _(spark, d):
    rows = px(spark, d).where("p IS NOT NULL").select(*KEY, "p").withColumn("mes", F.month("fecha"))
    means = rows.groupBy(*SERIES, "mes").agg((F.sum("p").cast("double") / F.count("p")).alias("media"))
    last = windows.latest(rows)
    return last.join(means, [*SERIES, "mes"]).select(*KEY, "p", ((F.col("p") - F.col("media")) / F.col("media")).alias("desvio"))


@query(
    "a06_market_days",
    f"""WITH {PX}, k AS (SELECT mercado_id, fecha, producto_id, p, m, row_number() OVER (PARTITION BY mercado_id, fecha ORDER BY p, producto_id) AS barato, row_number() OVER (PARTITION BY mercado_id, fecha ORDER BY p DESC, producto_id) AS caro FROM px WHERE p IS NOT NULL)
 SELECT mercado_id, fecha, count(*) AS n, sum(m)::BIGINT AS masa, string_agg(CAST(producto_id AS VARCHAR), ' ' ORDER BY barato) FILTER (barato <= 5) AS baratos, string_agg(CAST(producto_id AS VARCHAR), ' ' ORDER BY caro) FILTER (caro <= 5) AS caros FROM k GROUP BY ALL""",
)
def _(spark, d):
    # The products of one market and day are few: the list of products is a fixed dimension.
    day = px(spark, d).where("p IS NOT NULL").groupBy("mercado_id", "fecha")
    rows = day.agg(F.count("*").alias("n"), F.sum("m").alias("masa"), F.array_sort(F.collect_list(F.struct("p", "producto_id"))).alias("a"), F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "producto_id"))).alias("z"))
    five = lambda c: F.array_join(F.transform(F.slice(c, 1, 5), lambda x: x["producto_id"].cast("string")), " ")
    return rows.select("mercado_id", "fecha", "n", "masa", five("a").alias("baratos"), five("z").alias("caros"))


@query(
    "a07_weeks",
    f"""WITH {PX} SELECT producto_id, mercado_id, printf('%d-W%02d', isoyear(fecha), week(fecha)) AS semana, count(p) AS n, arg_min(p, fecha) FILTER (p IS NOT NULL) AS abre, arg_max(p, fecha) FILTER (p IS NOT NULL) AS cierra, min(p) AS minimo, max(p) AS maximo,
 sum(m)::BIGINT AS masa, count(m) AS dias_masa, count(*) FILTER (tendencia = 'En Alza') AS alzas, count(*) FILTER (tendencia = 'En Baja') AS bajas FROM px GROUP BY ALL""",
)
def _(spark, d):
    there = F.when(F.col("p").isNotNull(), F.col("fecha"))
    rows = px(spark, d).groupBy(*SERIES, period("fecha", "semana").alias("semana"))
    return rows.agg(
        F.count("p").alias("n"), F.min_by("p", there).alias("abre"), F.max_by("p", there).alias("cierra"), F.min("p").alias("minimo"), F.max("p").alias("maximo"),
        F.sum("m").alias("masa"), F.count("m").alias("dias_masa"), F.count_if(F.col("tendencia") == "En Alza").alias("alzas"), F.count_if(F.col("tendencia") == "En Baja").alias("bajas"),
    )


@query(
    "a11_up_and_down",
    f"WITH {PX}, {_RETURNS} SELECT mercado_id, fecha, count(*) FILTER (v > 0) AS suben, count(*) FILTER (v < 0) AS bajan, count(*) FILTER (v = 0) AS iguales FROM r GROUP BY ALL",
)
def _(spark, d):
    return returns(spark, d).groupBy("mercado_id", "fecha").agg(*[F.count_if(c).alias(n) for n, c in (("suben", F.col("v") > 0), ("bajan", F.col("v") < 0), ("iguales", F.col("v") == 0))])


@query(
    "a19_percentiles",
    "SELECT event_type, quantile_disc(CAST(floor(value * 100 + 0.5) AS BIGINT), 0.5) AS p50, quantile_disc(CAST(floor(value * 100 + 0.5) AS BIGINT), 0.95) AS p95, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())",
)
def _(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.floor(F.col("value") * 100 + 0.5).cast("bigint"))
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)").cast("bigint")
    return rows.groupingSets([[F.col("event_type")], []], "event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.count("*").alias("n"))


@query("a21_corpus_size", "SELECT tipo, lang, count(*) AS textos, coalesce(sum(length(text)), 0)::BIGINT AS caracteres, count(text) AS con_texto FROM documents GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "documents").groupBy("tipo", "lang").agg(F.count("*").alias("textos"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("caracteres"), F.count("text").alias("con_texto"))


# -- windows ------------------------------------------------------------------------------------


@query("w01_latest", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p, m FROM px QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1")
def _(spark, d):
    return windows.latest(px(spark, d).select(*KEY, "p", "m"))


@query("w02_returns", f"WITH {PX}, {_RETURNS} SELECT * FROM r")
def _(spark, d):
    return returns(spark, d)


_Z = f"""v AS (SELECT *, list(p) OVER k AS l, count(p) OVER k AS n, sum(p) OVER k AS s, sum(p * p) OVER k AS q FROM px WHERE p IS NOT NULL WINDOW k AS ({W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, list_median(l) AS med FROM v), d AS (SELECT *, list_median(list_transform(l, lambda x: abs(x - med))) * 1.4826 AS mad, sqrt(CAST(n * q - s * s AS DOUBLE)) / n AS sd FROM c),
 z AS (SELECT producto_id, mercado_id, fecha, p, CASE WHEN n < 6 THEN NULL WHEN mad > 0 THEN (p - med) / mad WHEN sd > 0 THEN (p - med) / sd WHEN p <> med THEN sign(p - med) * 99.0 END AS z FROM d)"""


@query("w05_robust_z", f"WITH {PX}, {_Z} SELECT * FROM z")
def _(spark, d):
    return windows.robust_z(px(spark, d), "p")


@query("w08_top_anomalies", f"WITH {PX}, {_Z}, k AS (SELECT *, row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY floor(abs(z) * 1e6 + 0.5) DESC, fecha) AS rango FROM z WHERE abs(z) >= 3.5) SELECT producto_id, mercado_id, fecha, p, rango FROM k WHERE rango <= 5")
def _(spark, d):
    hot = windows.robust_z(px(spark, d), "p").where("abs(z) >= 3.5")
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc(F.floor(F.abs("z") * 1e6 + 0.5)), "fecha"))
    return hot.withColumn("rango", rank).where("rango <= 5").drop("z")


#: What anomalies are looked for in.
VALUES = {"precio": "p", "volumen": "m"}


@query("w06_anomalies")
def _(spark, d):
    """Prices and masses far from the history of their series."""
    return windows.anomalies(px(spark, d), VALUES)


def top_anomalies(df: DataFrame) -> DataFrame:
    """The five greatest of each series and tipo, and all of the last date of their market; rango tells them apart."""
    hot = windows.anomalies(df, VALUES)
    last = df.groupBy("mercado_id").agg(F.max("fecha").alias("_f"))
    rank = F.row_number().over(Window.partitionBy(*SERIES, "tipo").orderBy(F.desc(F.floor(F.abs("z") * 1e6 + 0.5)), "fecha"))
    return hot.withColumn("rango", rank).join(last, "mercado_id").where("rango <= 5 OR fecha = _f").drop("_f")


@query("w08_featured_anomalies")
def _(spark, d):
    return top_anomalies(px(spark, d))


def _walk_sql(h: int) -> str:
    return f"""y AS (SELECT producto_id, mercado_id, fecha, p AS y, row_number() OVER k - 1 AS i, count(*) OVER (PARTITION BY producto_id, mercado_id) AS n, lead(p, {h}) OVER k AS real, lag(p, {h}) OVER k AS x, lag(p, 1) OVER k AS l1, lag(p, 2) OVER k AS l2, lag(p, 3) OVER k AS l3, lag(p, 4) OVER k AS l4
  FROM px WHERE p IS NOT NULL WINDOW k AS ({W})),
 e AS (SELECT *, CAST(count(x) OVER k AS DOUBLE) AS c, CAST(sum(x) OVER k AS DOUBLE) AS sx, CAST(sum(CASE WHEN x IS NOT NULL THEN y END) OVER k AS DOUBLE) AS sy, CAST(sum(x * x) OVER k AS DOUBLE) AS sxx, CAST(sum(x * y) OVER k AS DOUBLE) AS sxy FROM y WINDOW k AS ({W})),
 a AS (SELECT *, c * sxx - sx * sx AS den, CASE WHEN c * sxx - sx * sx <> 0 THEN (c * sxy - sx * sy) / (c * sxx - sx * sx) END AS a FROM e),
 f AS (SELECT producto_id, mercado_id, i, n, real, CAST(l4 AS DOUBLE) AS estacional, (y + l1 + l2 + l3 + l4) / 5.0::DOUBLE + (2 * y + l1 - l3 - 2 * l4) / 10.0::DOUBLE * {2 + h}.0::DOUBLE AS tendencia,
  CASE WHEN c < 5 THEN NULL WHEN den <> 0 THEN a * y + (sy - a * sx) / c ELSE (sx / c * y + 1) * (sy / c) / (sx / c * (sx / c) + 1) END AS ar1 FROM a WHERE i >= 29 AND real IS NOT NULL)"""


@query("w11_forecasts", f"WITH {PX}, {_walk_sql(1)} SELECT producto_id, mercado_id, i, n, real, estacional, floor(tendencia * 1000 + 0.5) AS tendencia, floor(ar1 * 1000 + 0.5) AS ar1 FROM f")
def _(spark, d):
    made = windows.forecasts(px(spark, d), "p")
    return made.select(*SERIES, "i", "n", "real", "estacional", *[F.floor(F.col(c) * 1000 + 0.5).cast("double").alias(c) for c in ("tendencia", "ar1")])


_MAE = """o AS (SELECT *, n - 1 - 29 AS m, i - 29 AS w FROM f), u AS (SELECT * FROM o WHERE m <= 60 OR list_contains(list_transform(range(60), lambda k: k * m // 60), w)),
 t AS (SELECT producto_id, mercado_id, metodo, CAST(floor(abs(v - real) * 1000 + 0.5) AS BIGINT) AS e FROM (SELECT producto_id, mercado_id, real, unnest(['estacional', 'tendencia', 'ar1']) AS metodo, unnest([estacional, tendencia, ar1]) AS v FROM u) WHERE v IS NOT NULL),
 mae AS (SELECT producto_id, mercado_id, metodo, CAST(sum(e) AS DOUBLE) / count(*) / 1000 AS mae, count(*) AS origenes FROM t GROUP BY ALL)"""
METHODS = ("estacional", "tendencia", "ar1")


@query("w13_walk_forward", f"WITH {PX}, {_walk_sql(1)}, {_MAE} SELECT * FROM mae")
def _(spark, d):
    return windows.walk_forward(windows.forecasts(px(spark, d), "p"), METHODS)


@query("w20_best_method", f"WITH {PX}, {_walk_sql(1)}, {_MAE} SELECT metodo, count(*) AS series FROM (SELECT * FROM mae QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY mae, metodo) = 1) GROUP BY metodo")
def _(spark, d):
    best = windows.walk_forward(windows.forecasts(px(spark, d), "p"), METHODS).groupBy(*SERIES).agg(F.min(F.struct("mae", "metodo")).alias("b"))
    return best.groupBy(F.col("b.metodo").alias("metodo")).agg(F.count("*").alias("series"))


@query("w17_refitted")
def _(spark, d):
    return refitted(px(spark, d), "p", "m", rows=60)


@query("a14_volume_gate")
def _(spark, d):
    """Does volume improve the regression? Mean errors over the series that have both."""
    rows = refitted(px(spark, d), "p", "m", models=("ar1", "ar1_volumen")).groupBy(*SERIES)
    both = rows.agg(F.max(F.when(F.col("metodo") == "ar1", F.col("mae"))).alias("a"), F.max(F.when(F.col("metodo") == "ar1_volumen", F.col("mae"))).alias("b")).where("b IS NOT NULL")
    means = both.agg(F.count("*").alias("series"), F.avg("a").alias("mae_control"), F.avg("b").alias("mae_volumen"))
    return means.withColumn("mejora", F.try_divide(F.col("mae_control") - F.col("mae_volumen"), F.col("mae_control")) * 100)


@query("w18_carried", f"WITH {PX} SELECT producto_id, mercado_id, fecha, coalesce(last_value(m IGNORE NULLS) OVER ({W}), first_value(m IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS m FROM px")
def _(spark, d):
    return px(spark, d).select(*KEY, windows.carried("m").alias("m"))


@query("w22_sampled", f"WITH {PX}, k AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY producto_id, mercado_id) AS n FROM px) SELECT producto_id, mercado_id, fecha, p FROM k WHERE i % CAST(ceil(n / 140) AS BIGINT) = 0 OR i = n - 1")
def _(spark, d):
    return windows.sampled(px(spark, d).select(*KEY, "p"), 140)


@query("w23_tail", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p FROM px WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) <= 30")
def _(spark, d):
    return windows.tail(px(spark, d).select(*KEY, "p"), "p", 30)


@query("w25_median_gap", f"WITH {PX} SELECT producto_id, mercado_id, median(paso) AS paso FROM (SELECT producto_id, mercado_id, CAST(fecha - lag(fecha) OVER ({W}) AS BIGINT) AS paso FROM px) GROUP BY ALL")
def _(spark, d):
    return windows.median_gap(px(spark, d))


@query(
    "w28_islands",
    f"""WITH {PX}, k AS (SELECT *, sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) OVER ({W}) AS i FROM px), g AS (SELECT producto_id, mercado_id, i, min(fecha) AS desde, max(fecha) AS hasta, count(*) AS n FROM k WHERE p IS NOT NULL GROUP BY ALL)
 SELECT producto_id, mercado_id, desde, hasta, n, row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY desde) AS tramo FROM g""",
)
def _(spark, d):
    return windows.islands(px(spark, d), "p")


# -- rankings -----------------------------------------------------------------------------------


@query(
    "k01_movers",
    f"WITH {PX}, {_RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY mercado_id, fecha ORDER BY v DESC, producto_id) AS rango FROM r) SELECT mercado_id, fecha, producto_id, v, rango FROM k WHERE rango <= 3",
)
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("mercado_id", "fecha").orderBy(F.desc("v"), "producto_id"))
    return returns(spark, d).withColumn("rango", rank).where("rango <= 3").select("mercado_id", "fecha", "producto_id", "v", "rango")


@query("k11_dearest", f"WITH {PX} SELECT producto_id, mercado_id, p FROM px WHERE fecha = (SELECT max(fecha) FROM px) AND p IS NOT NULL ORDER BY p DESC, producto_id, mercado_id LIMIT 10")
def _(spark, d):
    rows = px(spark, d).where("p IS NOT NULL")
    last = table(spark, d, "precios_diarios").where("producto_id IS NOT NULL AND mercado_id IS NOT NULL").agg(F.max("fecha").alias("fecha"))
    return rows.join(F.broadcast(last), "fecha").select(*SERIES, "p").orderBy(F.desc("p"), *SERIES).limit(10)


# -- questions ----------------------------------------------------------------------------------

_DAYS = "SELECT DISTINCT fecha FROM precios_diarios WHERE fecha IS NOT NULL"


@query(
    "f25_date_ranges",
    f"""WITH f AS ({_DAYS}), q AS (SELECT fecha, unnest(['precio de la papa hoy', 'y ayer?', 'esta semana', 'la semana pasada', 'este mes', 'el mes pasado', 'el año pasado', 'este año', 'los últimos 10 días', 'el 2024-05-01', 'cuánto suele costar en agosto', 'nada']) AS pregunta FROM f),
 m AS (SELECT *, fecha - CAST(isodow(fecha) - 1 AS INTEGER) AS lunes, CAST(date_trunc('month', fecha) AS DATE) AS mes, CAST(date_trunc('year', fecha) AS DATE) AS anio FROM q)
 SELECT fecha, pregunta, CASE WHEN pregunta LIKE '%hoy' THEN fecha WHEN pregunta = 'y ayer?' THEN fecha - 1 WHEN pregunta = 'esta semana' THEN lunes WHEN pregunta = 'la semana pasada' THEN lunes - 7 WHEN pregunta = 'este mes' THEN mes
  WHEN pregunta = 'el mes pasado' THEN CAST(mes - INTERVAL 1 MONTH AS DATE) WHEN pregunta = 'el año pasado' THEN CAST(anio - INTERVAL 1 YEAR AS DATE) WHEN pregunta = 'este año' THEN anio WHEN pregunta LIKE 'los%' THEN fecha - 10 WHEN pregunta LIKE 'el 2024%' THEN DATE '2024-05-01' END AS desde,
  CASE WHEN pregunta = 'y ayer?' THEN fecha - 1 WHEN pregunta = 'la semana pasada' THEN lunes - 1 WHEN pregunta = 'el mes pasado' THEN mes - 1 WHEN pregunta = 'el año pasado' THEN anio - 1 WHEN pregunta LIKE 'el 2024%' THEN DATE '2024-05-01' WHEN pregunta LIKE 'cuánto%' OR pregunta = 'nada' THEN NULL ELSE fecha END AS hasta FROM m""",
)
def _(spark, d):
    asked = "precio de la papa hoy|y ayer?|esta semana|la semana pasada|este mes|el mes pasado|el año pasado|este año|los últimos 10 días|el 2024-05-01|cuánto suele costar en agosto|nada".split("|")
    days = table(spark, d, "precios_diarios").where("fecha IS NOT NULL").select("fecha").distinct()
    rows = days.withColumn("pregunta", F.explode(F.array(*map(F.lit, asked)))).withColumn("r", date_range("pregunta", "fecha"))
    return rows.select("fecha", "pregunta", "r.desde", "r.hasta")


@query("f28_numbers")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", numbers("text").alias("cifras"))


@query("r09_mentions")
def _(spark, d):
    """The products that the questions of the query set name."""
    asked = _asked(table(spark, d, "documents"))
    return mentions(asked, table(spark, d, "productos"), "pregunta", "texto", "id", "nombre_canonico")


# -- retrieval ----------------------------------------------------------------------------------

_ASKED = "q AS (SELECT doc_id AS pregunta, concat(coalesce(producto, ''), ' ', coalesce(mercado, ''), ' ', coalesce(tipo, '')) AS texto FROM documents WHERE doc_id % 20 = 0)"


def _asked(docs: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    words = F.concat_ws(" ", F.coalesce("producto", F.lit("")), F.coalesce("mercado", F.lit("")), F.coalesce("tipo", F.lit("")))
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("pregunta"), words.alias("texto"))


_BM25 = f"""t AS (SELECT doc_id, list_filter(string_split_regex(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM documents), z AS (SELECT count(*) AS n, avg(len(l)) AS media FROM t), {_ASKED},
 p AS (SELECT token, doc_id, largo, count(*) AS tf FROM (SELECT doc_id, len(l) AS largo, unnest(l) AS token FROM t) GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
 a AS (SELECT DISTINCT pregunta, unnest(list_filter(string_split_regex(lower(strip_accents(texto)), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM q),
 bs AS (SELECT pregunta, doc_id, sum(CAST(floor(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * largo / media)) * 1e9 + 0.5) AS BIGINT)) AS s FROM p JOIN f USING (token) JOIN a USING (token), z GROUP BY ALL),
 b AS (SELECT pregunta, doc_id, CAST(s AS DOUBLE) / 1e9 AS bm25, row_number() OVER (PARTITION BY pregunta ORDER BY s DESC, doc_id) AS rango FROM bs)"""


@query("r04_bm25", f"WITH {_BM25} SELECT * FROM b WHERE rango <= 10")
def _(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.bm25(docs.select("doc_id", "text"), _asked(docs), "doc_id", "text", "pregunta", "texto")


_KNN = """s AS (SELECT q.vec_id AS pregunta, e.vec_id, CAST(round_even(list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) / 1e-5, 0) AS BIGINT) AS coseno FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
 n AS (SELECT pregunta, vec_id, coseno, row_number() OVER (PARTITION BY pregunta ORDER BY coseno DESC, vec_id) AS rango FROM s QUALIFY rango <= 10)"""


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("pregunta"), F.col("embedding").alias("v"))
    return retrieval.nearest(e, asked, "vec_id", "embedding", "pregunta", "v")


@query("r06_nearest", f"WITH {_KNN} SELECT * FROM n")
def _(spark, d):
    return _nearest(spark, d)


@query(
    "r08_fused",
    f"""WITH {_BM25}, {_KNN}, u AS (SELECT pregunta, doc_id, rango FROM b WHERE rango <= 40 UNION ALL SELECT pregunta, vec_id, rango FROM n), r AS (SELECT pregunta, doc_id, sum(CAST(floor(1e12 / (60 + rango) + 0.5) AS BIGINT)) AS s FROM u GROUP BY ALL)
 SELECT pregunta, doc_id, CAST(s AS DOUBLE) / 1e12 AS rrf, row_number() OVER (PARTITION BY pregunta ORDER BY s DESC, doc_id) AS rango FROM r QUALIFY rango <= 10""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    lexical = retrieval.bm25(docs.select("doc_id", "text"), _asked(docs), "doc_id", "text", "pregunta", "texto", 40)
    vector = _nearest(spark, d).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fused([lexical, vector], "pregunta", "doc_id")


@query(
    "a17_recall",
    f"""WITH {_KNN}, g AS (SELECT q.vec_id AS pregunta, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0), h AS (SELECT pregunta, count(*) AS h, min(rango) AS r FROM n JOIN g USING (pregunta, vec_id) GROUP BY ALL), t AS (SELECT pregunta, count(*) AS n FROM g GROUP BY ALL)
 SELECT t.pregunta, coalesce(h, 0) / n AS recall, coalesce(1 / r, 0) AS mrr FROM t LEFT JOIN h USING (pregunta)""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    near = _nearest(spark, d)
    # Relevant: the same label. Counted by label, not listed in pairs.
    labels = e.select("vec_id", "label")
    asked = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("pregunta"), "label")
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    hits = near.join(asked, "pregunta").join(labels.withColumnRenamed("label", "_of"), "vec_id").where("label = _of")
    got = hits.groupBy("pregunta").agg(F.count("*").alias("h"), F.min("rango").alias("r"))
    return asked.join(size, "label").join(got, "pregunta", "left").select("pregunta", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("mrr"))


# -- event time ---------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("v", F.floor(F.col("value") * 100 + 0.5).cast("bigint"))


@query("t07_hours", "SELECT date_trunc('hour', ts) AS inicio, date_trunc('hour', ts) + INTERVAL 1 HOUR AS fin, event_type, count(*) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT))::BIGINT AS suma, min(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS minimo, max(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS maximo FROM events GROUP BY ALL")
def _(spark, d):
    from lonja.streaming.prices import windows as event_windows

    return _local(event_windows(_events(spark, d), "ts", ["event_type"], "v"))


@query(
    "t07_sessions",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER k < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS abre FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(abre) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM a)
 SELECT min(ts) AS inicio, max(ts) + INTERVAL 30 MINUTE AS fin, user_id, count(*) AS n FROM b GROUP BY user_id, i""",
)
def _(spark, d):
    from lonja.streaming.prices import sessions

    return _local(sessions(_events(spark, d), "ts", ["user_id"]))


def _local(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("inicio", "fin")})
