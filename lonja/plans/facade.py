"""The functions of the price service as queries, and the texts and documents that are published from the prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions import formats
from lonja.functions.calendar import long_date
from lonja.functions.text import slug
from lonja.operators import windows
from lonja.operators.series import SERIES
from lonja.plans.general import KEY
from lonja.plans.rankings import _BOTH
from lonja.plans.reference import _RETURNS, PX, px
from lonja.plans.registry import registry
from lonja.plans.scalars import _LONG, _PERCENT, _SOLES
from lonja.service import Service, parsed
from lonja.session import table

QUERIES, SQL, query = registry()


def _first(spark: SparkSession, d: str, n: int = 1) -> list[str]:
    """The first names of the list, by id."""
    return [r[0] for r in table(spark, d, "productos").where("nombre_canonico IS NOT NULL").orderBy("id").limit(n).select("nombre_canonico").collect()]


_OWN = f"{PX}, g AS (SELECT px.* FROM px JOIN mercados ON id = mercado_id WHERE codigo = 'GMML'), uno AS (SELECT id FROM productos WHERE nombre_canonico IS NOT NULL ORDER BY id LIMIT 1)"

# -- service ------------------------------------------------------------------------------------


@query("v01_coverage", f"WITH {_OWN} SELECT count(*) AS filas, count(DISTINCT fecha) AS fechas, min(fecha) AS desde, max(fecha) AS hasta, count(DISTINCT producto_id) AS productos FROM g")
def _(spark, d):
    return Service(spark, d).coverage()


@query("v02_products", "SELECT id, nombre_canonico AS nombre, trim(lower(regexp_replace(strip_accents(nombre_canonico), '[^a-zA-Z0-9]+', '-', 'g')), '-') AS slug FROM productos WHERE contains(lower(strip_accents(nombre_canonico)), 'papa')")
def _(spark, d):
    return Service(spark, d).products("PÁPA")


@query("v03_current", f"WITH {_OWN}, c AS (SELECT producto_id, fecha, p, lag(p) OVER (ORDER BY fecha) AS q FROM g WHERE p IS NOT NULL AND producto_id = (SELECT id FROM uno)) SELECT producto_id, fecha, p, floor(CAST(p - q AS DOUBLE) / q * 1e6 + 0.5) AS cambio FROM c QUALIFY row_number() OVER (ORDER BY fecha DESC) = 1")
def _(spark, d):
    names = _first(spark, d)
    rows = Service(spark, d).current(names[0]) if names else px(spark, d).withColumn("cambio", windows.change("p")).limit(0)
    return rows.select("producto_id", "fecha", "p", F.floor(F.col("cambio") * 1e6 + 0.5).cast("double").alias("cambio"))


@query("v04_series", f"WITH {_OWN} SELECT fecha, p, m, tendencia FROM g WHERE producto_id = (SELECT id FROM uno) AND fecha BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'")
def _(spark, d):
    names = _first(spark, d)
    return Service(spark, d).series(names[0], "2024-03-01", "2024-09-30") if names else px(spark, d).select("fecha", "p", "m", "tendencia").limit(0)


@query("v04_summary", f"WITH {_OWN}, s AS (SELECT * FROM g WHERE producto_id = (SELECT id FROM uno) AND p IS NOT NULL) SELECT count(*) AS n, min(p) AS minimo, max(p) AS maximo, CAST(sum(p) AS DOUBLE) / count(*) AS media, min(fecha) AS desde, max(fecha) AS hasta, arg_min(p, fecha) AS primero, arg_max(p, fecha) AS ultimo FROM s HAVING count(*) > 0")
def _(spark, d):
    names = _first(spark, d)
    service = Service(spark, d)
    return service.summary(names[0]) if names else service.summarised(px(spark, d).limit(0))


@query("v05_forecast")
def _(spark, d):
    """The forecast of the first product, with its caveat and whether it beats the plain method."""
    names = _first(spark, d)
    return Service(spark, d).forecast(names[0]) if names else px(spark, d).select("producto_id").limit(0)


@query("v06_anomalies", f"WITH {PX}, {_BOTH}, u AS (SELECT a.*, max(fecha) OVER (PARTITION BY producto_id, mercado_id, tipo) AS f FROM a JOIN mercados ON id = mercado_id WHERE codigo = 'GMML' AND valor IS NOT NULL) SELECT producto_id, tipo, fecha, valor FROM u WHERE abs(z) >= 3.5 AND fecha = f ORDER BY floor(abs(z) * 1e6 + 0.5) DESC, producto_id, tipo LIMIT 10")
def _(spark, d):
    return Service(spark, d).anomalies(10).select("producto_id", "tipo", "fecha", "valor")


@query(
    "v07_compared",
    f"WITH {_OWN}, tres AS (SELECT id FROM productos WHERE nombre_canonico IS NOT NULL ORDER BY id LIMIT 3), t AS (SELECT * FROM g WHERE p IS NOT NULL AND producto_id IN (SELECT id FROM tres) QUALIFY row_number() OVER (PARTITION BY producto_id ORDER BY fecha DESC) <= 30), s AS (SELECT producto_id, arg_max(p, fecha) AS ultimo, min(p) AS minimo, max(p) AS maximo, CAST(sum(p) AS DOUBLE) / count(*) AS media, count(*) AS n FROM t GROUP BY ALL) SELECT tres.id AS producto_id, ultimo, minimo, maximo, media, n, row_number() OVER (ORDER BY ultimo NULLS LAST, tres.id) AS lugar FROM tres LEFT JOIN s ON s.producto_id = tres.id",
)
def _(spark, d):
    """Three products side by side, in the order of their last price; those without one last."""
    names = _first(spark, d, 3)
    rows = Service(spark, d).compare(names) if names else px(spark, d).limit(0).select("producto_id", *[F.lit(0).alias(c) for c in ("ultimo", "minimo", "maximo", "media", "n")])
    return rows.select("producto_id", "ultimo", "minimo", "maximo", "media", "n", F.row_number().over(Window.orderBy(F.asc_nulls_last("ultimo"), "producto_id")).alias("lugar"))


@query("v08_verified", f"WITH {_OWN}, u AS (SELECT producto_id, mercado_id, fecha, p FROM px WHERE p IS NOT NULL AND fecha = (SELECT max(fecha) FROM g WHERE p IS NOT NULL)), c AS (SELECT producto_id, p AS g FROM u JOIN mercados ON id = mercado_id WHERE codigo = 'GMML') SELECT u.mercado_id, u.producto_id, u.fecha, u.p, c.g, abs(CAST(u.p - c.g AS DOUBLE) / c.g) <= 0.15 AS coincide FROM u JOIN mercados ON id = mercado_id LEFT JOIN c USING (producto_id) WHERE codigo <> 'GMML'")
def _(spark, d):
    """The main market's last day checked against the others' prices of that day."""
    return Service(spark, d).verification()


@query("v08_day", f"WITH {_OWN}, c AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY producto_id ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM g), v AS (SELECT *, CAST(p - q AS DOUBLE) / q AS v FROM c WHERE fecha = (SELECT max(fecha) FROM g)) SELECT fecha, sum(m)::BIGINT AS masa, coalesce(array_to_string(list(producto_id ORDER BY v DESC, producto_id) FILTER (v > 0)[1:3], ' '), '') AS suben, coalesce(array_to_string(list(producto_id ORDER BY v, producto_id) FILTER (v < 0)[1:3], ' '), '') AS bajan FROM v GROUP BY fecha")
def _(spark, d):
    day = Service(spark, d).day()
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return day.select("fecha", "masa", flat("suben"), flat("bajan"))


@query(
    "r10_parsed",
    """WITH u AS (SELECT max(fecha) AS u FROM precios_diarios), q(i, texto, tipos) AS (VALUES (0, 'precio de hoy', NULL), (1, '¿hubo algo raro ayer?', 'evento_anomalia producto_periodo'), (2, '¿cuánto suele costar en agosto?', 'producto_perfil producto_periodo'), (3, 'los últimos 10 días', NULL), (4, 'el 2024-05-01', NULL), (5, 'hola', NULL))
 SELECT texto, tipos, CASE i WHEN 0 THEN u WHEN 1 THEN u - 1 WHEN 3 THEN u - 10 WHEN 4 THEN DATE '2024-05-01' END AS desde, CASE i WHEN 0 THEN u WHEN 1 THEN u - 1 WHEN 3 THEN u WHEN 4 THEN DATE '2024-05-01' END AS hasta, '' AS productos FROM q, u""",
)
def _(spark, d):
    """Questions read: the kinds of text, days and products that they ask for."""
    asked = ["precio de hoy", "¿hubo algo raro ayer?", "¿cuánto suele costar en agosto?", "los últimos 10 días", "el 2024-05-01", "hola"]
    last = table(spark, d, "precios_diarios").agg(F.max("fecha").alias("ultima"))
    names = table(spark, d, "productos").where("nombre_canonico IS NOT NULL").select(slug("nombre_canonico").alias("slug"), F.col("nombre_canonico").alias("nombre")).dropDuplicates(["slug"])
    read = parsed(spark.createDataFrame(list(enumerate(asked)), "pregunta int, texto string"), names, last)
    return read.select("texto", F.array_join("tipos", " ").alias("tipos"), "desde", "hasta", F.coalesce(F.array_join("productos", " "), F.lit("")).alias("productos"))


@query("v09_retrieved")
def _(spark, d):
    """The texts for one question, by words and vectors and with the floor."""
    return Service(spark, d).retrieve("¿qué pasó con el precio de la papa la última semana?")


# -- texts --------------------------------------------------------------------------------------

_NAMES = "JOIN productos ON productos.id = producto_id JOIN mercados ON mercados.id = mercado_id"
_SLUG = "trim(lower(regexp_replace(strip_accents(nombre_canonico), '[^a-zA-Z0-9]+', '-', 'g')), '-')"


def _named(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    products = table(spark, d, "productos").select(F.col("id").alias("producto_id"), F.col("nombre_canonico").alias("nombre"), slug("nombre_canonico").alias("slug"), "unidad_default")
    return rows.join(products, "producto_id").join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")


def _money(c: str):
    return formats.soles(F.col(c) / 10_000)


@query(
    "r02_profile_texts",
    f"""WITH {PX}, s AS (SELECT producto_id, mercado_id, count(p) AS n, min(fecha) FILTER (p IS NOT NULL) AS a, max(fecha) FILTER (p IS NOT NULL) AS z, min(p) AS lo, max(p) AS hi, arg_max(p, fecha) FILTER (p IS NOT NULL) AS u FROM px GROUP BY ALL HAVING count(p) > 0)
 SELECT concat('perfil:', {_SLUG}, ':', codigo) AS id, concat(nombre_canonico, ' en ', codigo, ': ', n, ' precios del ', strftime(a, '%Y-%m-%d'), ' al ', strftime(z, '%Y-%m-%d'), ', entre ', {_SOLES.replace('p +', 'lo +')}, ' y ', {_SOLES.replace('p +', 'hi +')}, '; el último, ', {_SOLES.replace('p +', 'u +')}, '.', CASE WHEN unidad_default IS NULL THEN '' ELSE concat(' Se publica por ', unidad_default, '.') END) AS texto FROM s {_NAMES}""",
)
def profile_texts(spark, d):
    """A text for each product and market from its whole history."""
    there = F.when(F.col("p").isNotNull(), F.col("fecha"))
    s = px(spark, d).groupBy(*SERIES).agg(F.count("p").alias("n"), F.min(there).alias("a"), F.max(there).alias("z"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.max_by("p", there).alias("u")).where("n > 0")
    unit = F.coalesce(F.concat(F.lit(" Se publica por "), "unidad_default", F.lit(".")), F.lit(""))
    text = F.concat("nombre", F.lit(" en "), "codigo", F.lit(": "), "n", F.lit(" precios del "), F.date_format("a", "yyyy-MM-dd"), F.lit(" al "), F.date_format("z", "yyyy-MM-dd"), F.lit(", entre "), _money("lo"), F.lit(" y "), _money("hi"), F.lit("; el último, "), _money("u"), F.lit("."), unit)
    return _named(spark, d, s).select(F.concat(F.lit("perfil:"), "slug", F.lit(":"), "codigo").alias("id"), text.alias("texto"))


@query(
    "r02_anomaly_texts",
    f"""WITH {PX}, {_BOTH} SELECT concat('anomalia:', {_SLUG}, ':', codigo, ':', strftime(fecha, '%Y-%m-%d'), ':', tipo) AS id,
 concat('El ', tipo, ' de ', nombre_canonico, ' en ', codigo, ' se apartó de su historia el ', {_LONG.format('fecha')}, ': ', CASE WHEN tipo = 'precio' THEN {_SOLES.replace('p +', 'valor +')} ELSE concat((valor + 50) // 100, ' t') END, CASE WHEN z > 0 THEN ', por encima.' ELSE ', por debajo.' END) AS texto FROM a {_NAMES} WHERE abs(z) >= 3.5""",
)
def anomaly_texts(spark, d):
    """A text for each price or mass far from its history; it says that it is so, not why."""
    hot = _named(spark, d, windows.anomalies(px(spark, d), {"precio": "p", "volumen": "m"}))
    value = F.when(F.col("tipo") == "precio", _money("valor")).otherwise(formats.tonnes(F.col("valor") / 100, spaced=False))
    text = F.concat(F.lit("El "), "tipo", F.lit(" de "), "nombre", F.lit(" en "), "codigo", F.lit(" se apartó de su historia el "), long_date("fecha"), F.lit(": "), value, F.when(F.col("z") > 0, ", por encima.").otherwise(", por debajo."))
    return hot.select(F.concat(F.lit("anomalia:"), "slug", F.lit(":"), "codigo", F.lit(":"), F.date_format("fecha", "yyyy-MM-dd"), F.lit(":"), "tipo").alias("id"), text.alias("texto"))


_CHANGES = "LEFT JOIN r USING (producto_id, mercado_id, fecha)"


@query(
    "r02_other_market_texts",
    f"""WITH {PX}, {_RETURNS}, u AS (SELECT px.*, v, max(fecha) OVER (PARTITION BY mercado_id) AS f FROM px {_CHANGES}) SELECT concat('otro:', {_SLUG}, ':', codigo) AS id,
 concat(nombre_canonico, ' en ', codigo, ', ', {_LONG.format('fecha')}, ': ', CASE WHEN p IS NULL THEN 'sin precio' ELSE {_SOLES} END, CASE WHEN v IS NULL THEN '' ELSE concat(' (', {_PERCENT}, ')') END, '. No se compara con el mercado principal.') AS texto FROM u {_NAMES} WHERE fecha = f AND codigo <> 'GMML'""",
)
def other_texts(spark, d):
    """A text for each product of another market on that market's last day."""
    rows = px(spark, d).withColumn("v", F.floor(windows.change("p") * 1e6 + 0.5))
    last = rows.groupBy("mercado_id").agg(F.max("fecha").alias("fecha"))
    u = _named(spark, d, rows.join(last, ["mercado_id", "fecha"])).where("codigo <> 'GMML'")
    moved = F.coalesce(F.concat(F.lit(" ("), formats.percent(F.when(F.col("p").isNotNull() & F.col("v").isNotNull(), F.col("v") / 10_000)), F.lit(")")), F.lit(""))
    moved = F.when(F.col("v").isNotNull(), moved).otherwise("")
    price = F.when(F.col("p").isNull(), "sin precio").otherwise(_money("p"))
    text = F.concat("nombre", F.lit(" en "), "codigo", F.lit(", "), long_date("fecha"), F.lit(": "), price, moved, F.lit(". No se compara con el mercado principal."))
    return u.select(F.concat(F.lit("otro:"), "slug", F.lit(":"), "codigo").alias("id"), text.alias("texto"))


@query(
    "r02_market_day_texts",
    f"""WITH {PX}, n AS (SELECT px.*, nombre_canonico AS nombre, codigo FROM px {_NAMES} WHERE p IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY mercado_id, fecha ORDER BY p, nombre) AS b, row_number() OVER (PARTITION BY mercado_id, fecha ORDER BY p DESC, nombre) AS c FROM n)
 SELECT concat('dia:', codigo, ':', strftime(fecha, '%Y-%m-%d')) AS id, concat(codigo, ', ', {_LONG.format('fecha')}, ': ', count(*), ' productos con precio. Más baratos: ', string_agg(concat(nombre, ' ', {_SOLES}), ', ' ORDER BY b) FILTER (b <= 3), '. Más caros: ', string_agg(concat(nombre, ' ', {_SOLES}), ', ' ORDER BY c) FILTER (c <= 3), '.') AS texto FROM k GROUP BY mercado_id, fecha, codigo""",
)
def day_texts(spark, d):
    """A text for each day of each market: how many products have a price, the cheapest and the dearest."""
    rows = _named(spark, d, px(spark, d).where("p IS NOT NULL"))
    # The products of one market and day are few: the list of products is a dimension.
    held = rows.groupBy("codigo", "mercado_id", "fecha").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("p", "nombre"))).alias("b"), F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), "nombre", "p"))).alias("c"))
    three = lambda c: F.array_join(F.transform(F.slice(c, 1, 3), lambda x: F.concat(x["nombre"], F.lit(" "), formats.soles(x["p"] / 10_000))), ", ")
    text = F.concat("codigo", F.lit(", "), long_date("fecha"), F.lit(": "), "n", F.lit(" productos con precio. Más baratos: "), three("b"), F.lit(". Más caros: "), three("c"), F.lit("."))
    return held.select(F.concat(F.lit("dia:"), "codigo", F.lit(":"), F.date_format("fecha", "yyyy-MM-dd")).alias("id"), text.alias("texto"))


@query("r01_corpus", " UNION ALL ".join(f"SELECT '{k}' AS clase, count(*) AS textos, count(DISTINCT id) AS ids, coalesce(sum(length(texto)), 0)::BIGINT AS caracteres FROM ({SQL[n]})" for k, n in (("perfil", "r02_profile_texts"), ("anomalia", "r02_anomaly_texts"), ("otro", "r02_other_market_texts"), ("dia", "r02_market_day_texts"))))
def _(spark, d):
    """The corpus of all texts made from the prices: how many of each class, whether ids are theirs alone, and their size."""
    parts = {"perfil": profile_texts, "anomalia": anomaly_texts, "otro": other_texts, "dia": day_texts}
    out = None
    for name, made in parts.items():
        part = made(spark, d).select(F.lit(name).alias("clase"), "id", "texto").groupBy("clase").agg(F.count("*").alias("textos"), F.countDistinct("id").alias("ids"), F.sum(F.length("texto")).alias("caracteres"))
        out = part if out is None else out.unionByName(part)
    return out


# -- snapshot -----------------------------------------------------------------------------------


@query(
    "s20_document",
    f"""WITH {PX}, {_RETURNS}, {_BOTH}, l AS (SELECT px.*, v, max(fecha) OVER (PARTITION BY mercado_id) AS f FROM px {_CHANGES}), u AS (SELECT * FROM l WHERE fecha = f),
 raro AS (SELECT a.mercado_id, a.producto_id, a.tipo FROM a JOIN (SELECT mercado_id, max(fecha) AS f FROM px GROUP BY ALL) x ON x.mercado_id = a.mercado_id AND x.f = a.fecha WHERE abs(z) >= 3.5), g AS (SELECT producto_id, fecha, p AS g FROM px JOIN mercados ON id = mercado_id WHERE codigo = 'GMML' AND p IS NOT NULL)
 SELECT codigo AS mercado, u.fecha, count(*) AS filas, count(u.p) AS con_precio, sum(u.m)::BIGINT AS masa, coalesce(array_to_string(list(u.producto_id ORDER BY v DESC, u.producto_id) FILTER (v > 0)[1:3], ' '), '') AS suben, coalesce(array_to_string(list(u.producto_id ORDER BY v, u.producto_id) FILTER (v < 0)[1:3], ' '), '') AS bajan,
 (SELECT count(*) FROM raro WHERE raro.mercado_id = u.mercado_id) AS anomalias, count(g.g) FILTER (u.p IS NOT NULL AND codigo <> 'GMML') AS comparados, u.fecha = (SELECT max(fecha) FROM px) AS vigente
 FROM u JOIN mercados ON id = u.mercado_id LEFT JOIN g ON g.producto_id = u.producto_id AND g.fecha = u.fecha GROUP BY codigo, u.mercado_id, u.fecha""",
)
def snapshot(spark, d):
    """Each market's last day as one row: what moved, what is odd, what could be checked, and whether it is the last day of all."""
    rows = px(spark, d).withColumn("v", F.floor(windows.change("p") * 1e6 + 0.5).cast("bigint"))
    last = rows.groupBy("mercado_id").agg(F.max("fecha").alias("fecha"))
    u = rows.join(last, ["mercado_id", "fecha"]).join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), F.col("codigo").alias("mercado")), "mercado_id")
    main = rows.where("p IS NOT NULL").join(table(spark, d, "mercados").where("codigo = 'GMML'").select(F.col("id").alias("mercado_id")), "mercado_id").select("producto_id", "fecha", F.col("p").alias("g"))
    odd = windows.anomalies(rows, {"precio": "p", "volumen": "m"}).join(last, ["mercado_id", "fecha"], "left_semi").groupBy("mercado_id").agg(F.count("*").alias("anomalias"))
    three = lambda ok, by: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(ok, F.struct(by.alias("o"), "producto_id")))), 1, 3), lambda x: x["producto_id"].cast("string")), " ")
    v = F.when(F.col("p").isNotNull(), F.col("v"))
    day = u.join(main, ["producto_id", "fecha"], "left").groupBy("mercado", "mercado_id", "fecha").agg(
        F.count("*").alias("filas"), F.count("p").alias("con_precio"), F.sum("m").alias("masa"), three(v > 0, -v).alias("suben"), three(v < 0, v).alias("bajan"),
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull() & (F.col("mercado") != "GMML")).alias("comparados"),
    )
    newest = rows.agg(F.max("fecha").alias("_u"))  # one date
    out = day.join(odd, "mercado_id", "left").crossJoin(F.broadcast(newest))
    return out.select("mercado", "fecha", "filas", "con_precio", "masa", "suben", "bajan", F.coalesce("anomalias", F.lit(0)).cast("bigint").alias("anomalias"), "comparados", F.col("fecha").eqNullSafe(F.col("_u")).alias("vigente"))
