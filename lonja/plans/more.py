"""Further queries of the price analytics: snapshots, texts from numbers, bands, floors of retrieval, layouts."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions.calendar import period
from lonja.functions.questions import numbers
from lonja.functions.text import slug, tokens
from lonja.operators import windows
from lonja.operators.index import closed, hashed
from lonja.operators.models import compared, forecasted
from lonja.operators.series import SERIES
from lonja.plans.general import KEY
from lonja.plans.reference import _MAE, METHODS, PX, W, _asked, _walk_sql, px
from lonja.service import hybrid
from lonja.session import table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- snapshots and exports ----------------------------------------------------------------------


@query(
    "s20_snapshot",
    f"""WITH {PX}, l AS (SELECT producto_id, mercado_id, max(fecha) AS ultima, count(p) AS n, string_agg(CAST(p AS VARCHAR), ',' ORDER BY fecha) AS serie FROM px GROUP BY ALL)
 SELECT codigo AS mercado, nombre_canonico AS nombre, ultima, n, coalesce(serie, '') AS serie FROM l JOIN productos ON productos.id = l.producto_id JOIN mercados ON mercados.id = l.mercado_id""",
)
def _(spark, d):
    """One row for each product of a market, with its prices in order: the rows of the published document."""
    series = px(spark, d).groupBy(*SERIES).agg(F.max("fecha").alias("ultima"), F.count("p").alias("n"), F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("fecha", "p")))).alias("s"))
    rows = series.join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), F.col("nombre_canonico").alias("nombre")), "producto_id")
    rows = rows.join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), F.col("codigo").alias("mercado")), "mercado_id")
    return rows.select("mercado", "nombre", "ultima", "n", F.array_join(F.transform("s", lambda x: x["p"].cast("string")), ",").alias("serie"))


@query("s23_latest_table", f"WITH {PX} SELECT nombre_canonico AS producto, fecha, p AS precio, m AS masa, px.tendencia FROM px JOIN productos ON productos.id = producto_id JOIN mercados ON mercados.id = mercado_id WHERE codigo = 'GMML' QUALIFY row_number() OVER (PARTITION BY producto_id ORDER BY fecha DESC) = 1")
def _(spark, d):
    main = table(spark, d, "mercados").where("codigo = 'GMML'").select(F.col("id").alias("mercado_id"))
    last = windows.latest(px(spark, d).join(main, "mercado_id").drop("mercado_id"), ["producto_id"])
    names = table(spark, d, "productos").select(F.col("id").alias("producto_id"), F.col("nombre_canonico").alias("producto"))
    return last.join(names, "producto_id").select("producto", "fecha", F.col("p").alias("precio"), F.col("m").alias("masa"), "tendencia")


# -- cleaning -----------------------------------------------------------------------------------


@query(
    "c06_clean_names",
    r"""WITH t AS (SELECT fila_id, trim(regexp_replace(producto, '\s+', ' ', 'g')) AS n FROM filas_reporte WHERE producto IS NOT NULL)
 SELECT fila_id, CASE WHEN n = upper(n) THEN lower(n) ELSE n END AS nombre, (length(n) >= 3 AND NOT contains(n, ',') AND regexp_matches(lower(strip_accents(n)), '[aeiou]')) AS valido FROM t""",
)
def _(spark, d):
    from lonja.functions.text import normalised

    n = F.trim(F.regexp_replace("producto", r"\s+", " "))
    ok = (F.length("n") >= 3) & ~F.contains(F.col("n"), F.lit(",")) & normalised("n").rlike("[aeiou]")
    rows = table(spark, d, "filas_reporte").where("producto IS NOT NULL").select("fila_id", n.alias("n"))
    return rows.select("fila_id", F.when(F.col("n") == F.upper("n"), F.lower("n")).otherwise(F.col("n")).alias("nombre"), ok.alias("valido"))


@query("c07_per_kilogram", "SELECT fila_id, CASE WHEN equiv_kg <> 0 AND NOT isnan(equiv_kg) AND NOT isnan(precio_hoy_unit) THEN CAST(floor(precio_hoy_unit / equiv_kg * 1e4 + 0.5) AS BIGINT) END AS p FROM filas_reporte")
def _(spark, d):
    ratio = F.try_divide(F.nanvl("precio_hoy_unit", F.lit(None)), F.nanvl("equiv_kg", F.lit(None)))
    return table(spark, d, "filas_reporte").select("fila_id", F.floor(ratio * 1e4 + 0.5).cast("bigint").alias("p"))


@query("c16_coverage", "SELECT r.fuente, count(DISTINCT r.reporte_id) AS reportes, count(f.fila_id) AS filas, count(f.producto) AS con_nombre FROM (SELECT DISTINCT reporte_id, fuente FROM reportes) r LEFT JOIN filas_reporte f USING (reporte_id) GROUP BY r.fuente")
def _(spark, d):
    reports = table(spark, d, "reportes").select("reporte_id", "fuente").distinct()
    lines = table(spark, d, "filas_reporte").groupBy("reporte_id").agg(F.count("fila_id").alias("f"), F.count("producto").alias("c"))
    rows = reports.join(lines, "reporte_id", "left").groupBy("fuente")
    return rows.agg(F.countDistinct("reporte_id").alias("reportes"), F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("filas"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("con_nombre"))


@query("c10_missing_headers", "SELECT DISTINCT reporte_id, array_to_string(list_filter(['unidad', 'producto', 'tendencia'], lambda k: NOT contains(lower(coalesce(fingerprint, '')), k)), ' ') AS faltan FROM reportes")
def _(spark, d):
    wanted = F.array(*map(F.lit, ("unidad", "producto", "tendencia")))
    gone = F.filter(wanted, lambda k: ~F.contains(F.lower(F.coalesce("fingerprint", F.lit(""))), k))
    return table(spark, d, "reportes").select("reporte_id", F.array_join(gone, " ").alias("faltan")).distinct()


@query(
    "f18_sparklines",
    f"""WITH {PX}, t AS (SELECT * FROM px WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) <= 60), s AS (SELECT *, min(p) OVER k AS lo, max(p) OVER k AS hi FROM t WINDOW k AS (PARTITION BY producto_id, mercado_id))
 SELECT producto_id, mercado_id, string_agg(CASE WHEN hi = lo THEN '0' ELSE CAST(CAST(floor(CAST((p - lo) * 7 AS DOUBLE) / (hi - lo)) AS BIGINT) AS VARCHAR) END, '' ORDER BY fecha) AS niveles FROM s GROUP BY ALL""",
)
def _(spark, d):
    whole = Window.partitionBy(*SERIES)
    rows = windows.tail(px(spark, d), "p", 60).withColumns({"lo": F.min("p").over(whole), "hi": F.max("p").over(whole)})
    level = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.floor(((F.col("p") - F.col("lo")) * 7).cast("double") / (F.col("hi") - F.col("lo"))))
    packed = rows.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("fecha", level.cast("string").alias("v")))).alias("w"))
    return packed.select(*SERIES, F.array_join(F.transform("w", lambda x: x["v"]), "").alias("niveles"))


# -- windows and aggregations -------------------------------------------------------------------


@query(
    "w19_bands",
    f"""WITH {PX}, {_walk_sql(1)}, u AS (SELECT *, CAST(floor((real - tendencia) * 1000 + 0.5) AS BIGINT) AS e FROM f),
 g AS (SELECT producto_id, mercado_id, count(*) AS c, CAST(sum(e) AS DOUBLE) AS s, CAST(sum(e * e) AS DOUBLE) AS q FROM u GROUP BY ALL) SELECT producto_id, mercado_id, c AS origenes, floor(sqrt(c * q - s * s) / c + 0.5) AS banda FROM g""",
)
def _(spark, d):
    """Population deviation of the signed errors of the trend from every origin, in thousandths of a price step."""
    made = windows.forecasts(px(spark, d), "p")
    e = F.floor((F.col("real") - F.col("tendencia")) * 1000 + 0.5).cast("bigint")
    g = made.withColumn("e", e).groupBy(*SERIES).agg(F.count("*").alias("c"), F.sum("e").cast("double").alias("s"), F.sum((F.col("e") * F.col("e")).cast("decimal(19,0)")).cast("double").alias("q"))
    return g.select(*SERIES, F.col("c").alias("origenes"), F.floor(F.sqrt(F.col("c") * F.col("q") - F.col("s") * F.col("s")) / F.col("c") + 0.5).cast("double").alias("banda"))


@query(
    "w24_supply_surge",
    f"""WITH {PX}, s AS (SELECT producto_id, mercado_id, fecha, m, sum(m) OVER k AS t, count(m) OVER k AS n FROM px WINDOW k AS ({W} RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
 SELECT producto_id, mercado_id, fecha, CAST(m * n AS DOUBLE) / t AS razon FROM s WHERE m IS NOT NULL AND t > 0 QUALIFY row_number() OVER (PARTITION BY mercado_id, fecha ORDER BY CAST(m * n AS DOUBLE) / t DESC, producto_id) <= 3""",
)
def _(spark, d):
    """Where a day's mass is furthest above the mean of its last seven days: the first three of each market and day."""
    week = Window.partitionBy(*SERIES).orderBy(F.unix_date("fecha")).rangeBetween(-6, 0)
    rows = px(spark, d).withColumns({"t": F.sum("m").over(week), "n": F.count("m").over(week)}).where("m IS NOT NULL AND t > 0")
    rows = rows.withColumn("razon", (F.col("m") * F.col("n")).cast("double") / F.col("t"))
    rank = F.row_number().over(Window.partitionBy("mercado_id", "fecha").orderBy(F.desc("razon"), "producto_id"))
    return rows.withColumn("k", rank).where("k <= 3").select(*KEY, "razon")


@query(
    "a03_compare",
    f"""WITH {PX}, t AS (SELECT * FROM px WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) <= 30)
 SELECT producto_id, mercado_id, count(*) AS n, arg_max(p, fecha) AS ultimo, min(p) AS minimo, max(p) AS maximo, CAST(sum(p) AS DOUBLE) / count(*) AS media, CAST(arg_max(p, fecha) - arg_min(p, fecha) AS DOUBLE) / arg_min(p, fecha) AS cambio FROM t GROUP BY ALL""",
)
def _(spark, d):
    last, first = F.max_by("p", "fecha"), F.min_by("p", "fecha")
    rows = windows.tail(px(spark, d), "p", 30).groupBy(*SERIES)
    return rows.agg(F.count("*").alias("n"), last.alias("ultimo"), F.min("p").alias("minimo"), F.max("p").alias("maximo"), (F.sum("p").cast("double") / F.count("*")).alias("media"), ((last - first).cast("double") / first).alias("cambio"))


@query(
    "a15_families",
    f"""WITH {PX}, {_walk_sql(1)}, {_MAE}, c AS (SELECT producto_id, mercado_id FROM mae GROUP BY ALL HAVING count(*) = 3)
 SELECT metodo, count(*) AS series, CAST(sum(CAST(floor(mae * 1000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS mae FROM mae JOIN c USING (producto_id, mercado_id) GROUP BY metodo""",
)
def _(spark, d):
    """Mean error of each method over the series on which all of them can be judged."""
    mae = windows.walk_forward(windows.forecasts(px(spark, d), "p"), METHODS)
    rows = mae.withColumn("c", F.count("*").over(Window.partitionBy(*SERIES))).where("c = 3")
    return rows.groupBy("metodo").agg(F.count("*").alias("series"), (F.sum(F.floor(F.col("mae") * 1000 + 0.5).cast("bigint")).cast("double") / F.count("*") / 1000).alias("mae"))


@query("a15_compared")
def _(spark, d):
    """Families of models one and seven steps ahead: their errors, ranking and winner."""
    return compared(px(spark, d), "p", "m", 1).unionByName(compared(px(spark, d), "p", "m", 7))


@query("w20_forecasted")
def _(spark, d):
    """The best model of each series and its forecast, one and seven steps ahead."""
    return forecasted(px(spark, d), "p", "m", (1, 7))


@query("a12_methods")
def _(spark, d):
    """For how many series each model was chosen."""
    return QUERIES["w20_forecasted"](spark, d).groupBy("h", "metodo").agg(F.count("*").alias("series"))


@query(
    "j09_co_movers",
    f"""WITH {PX}, v AS (SELECT producto_id, mercado_id, printf('%d-W%02d', isoyear(fecha), week(fecha)) AS semana, arg_min(p, fecha) AS abre, arg_max(p, fecha) AS cierra, count(*) AS n FROM px WHERE p IS NOT NULL GROUP BY ALL),
 r AS (SELECT producto_id, mercado_id, semana, CAST(floor(CAST(cierra - abre AS DOUBLE) / abre * 1e6 + 0.5) AS BIGINT) AS v FROM v WHERE n >= 2), s AS (SELECT *, sign(v) AS lado, row_number() OVER (PARTITION BY mercado_id, semana, sign(v) ORDER BY abs(v) DESC, producto_id) AS rango FROM r WHERE v <> 0)
 SELECT r.producto_id, r.mercado_id, r.semana, s.producto_id AS con, s.v FROM (SELECT * FROM s) r JOIN s ON s.mercado_id = r.mercado_id AND s.semana = r.semana AND s.lado = r.lado AND s.producto_id <> r.producto_id
 WHERE s.rango <= 4 QUALIFY row_number() OVER (PARTITION BY r.producto_id, r.mercado_id, r.semana ORDER BY abs(s.v) DESC, s.producto_id) <= 3""",
)
def _(spark, d):
    """The three products of the market that moved most in the same direction in each product's week.

    They are among the first four of their direction, so no pairs of products are made.
    """
    week = px(spark, d).where("p IS NOT NULL").groupBy(*SERIES, period("fecha", "semana").alias("semana")).agg(F.min_by("p", "fecha").alias("a"), F.max_by("p", "fecha").alias("z"), F.count("*").alias("n"))
    rows = week.where("n >= 2").select(*SERIES, "semana", F.floor((F.col("z") - F.col("a")).cast("double") / F.col("a") * 1e6 + 0.5).cast("bigint").alias("v")).where("v <> 0").withColumn("lado", F.signum("v"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("v")).alias("_o"), F.col("producto_id").alias("con"), "v"))), 1, 4)
    first = rows.groupBy("mercado_id", "semana", "lado").agg(top.alias("t"))
    near = rows.drop("v").join(first, ["mercado_id", "semana", "lado"])
    three = F.slice(F.filter("t", lambda x: x["con"] != F.col("producto_id")), 1, 3)
    return near.select(*SERIES, "semana", F.explode(three).alias("x")).select(*SERIES, "semana", "x.con", "x.v")


# -- texts and retrieval ------------------------------------------------------------------------


@query(
    "r02_period_texts",
    f"""WITH {PX}, v AS (SELECT producto_id, mercado_id, printf('%d-W%02d', isoyear(fecha), week(fecha)) AS semana, count(p) AS n, arg_min(p, fecha) FILTER (p IS NOT NULL) AS abre, arg_max(p, fecha) FILTER (p IS NOT NULL) AS cierra, coalesce(sum(m), 0)::BIGINT AS masa FROM px GROUP BY ALL HAVING count(p) > 0)
 SELECT concat('periodo:', trim(lower(regexp_replace(strip_accents(nombre_canonico), '[^a-zA-Z0-9]+', '-', 'g')), '-'), ':', codigo, ':', semana) AS id,
  concat(nombre_canonico, ' en ', codigo, ', ', semana, ': ', n, ' precios, de ', abre, ' a ', cierra, '; ingreso ', masa, '.') AS texto FROM v JOIN productos ON productos.id = v.producto_id JOIN mercados ON mercados.id = v.mercado_id""",
)
def _(spark, d):
    """A text for each product, market and week, from its numbers, with an id that never changes."""
    there = F.when(F.col("p").isNotNull(), F.col("fecha"))
    week = px(spark, d).groupBy(*SERIES, period("fecha", "semana").alias("semana")).agg(F.count("p").alias("n"), F.min_by("p", there).alias("abre"), F.max_by("p", there).alias("cierra"), F.coalesce(F.sum("m"), F.lit(0)).alias("masa")).where("n > 0")
    rows = week.join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), F.col("nombre_canonico").alias("nombre")), "producto_id").join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")
    text = F.concat("nombre", F.lit(" en "), "codigo", F.lit(", "), "semana", F.lit(": "), "n", F.lit(" precios, de "), "abre", F.lit(" a "), "cierra", F.lit("; ingreso "), "masa", F.lit("."))
    return rows.select(F.concat(F.lit("periodo:"), slug("nombre"), F.lit(":"), "codigo", F.lit(":"), "semana").alias("id"), text.alias("texto"))


@query(
    "r11_floor",
    """WITH k AS (SELECT doc_id, slug, tipo, CASE tipo WHEN 'producto_perfil' THEN 0 WHEN 'producto_periodo' THEN 1 WHEN 'evento_anomalia' THEN 2 END AS clase, row_number() OVER (PARTITION BY slug, tipo ORDER BY fecha_fin DESC NULLS LAST, doc_id) AS n FROM documents WHERE slug IS NOT NULL AND tipo IN ('producto_perfil', 'producto_periodo', 'evento_anomalia'))
 SELECT slug, doc_id, row_number() OVER (PARTITION BY slug ORDER BY clase, n) AS rango FROM k WHERE n <= CASE clase WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END""",
)
def _(spark, d):
    """What an answer about a product rests on at least: its profile, four latest periods, three latest anomalies."""
    kinds = {"producto_perfil": (0, 1), "producto_periodo": (1, 4), "evento_anomalia": (2, 3)}
    docs = table(spark, d, "documents").where(F.col("slug").isNotNull() & F.col("tipo").isin(*kinds)).select("doc_id", "slug", "tipo", "fecha_fin")
    order = F.row_number().over(Window.partitionBy("slug", "tipo").orderBy(F.desc_nulls_last("fecha_fin"), "doc_id"))
    pick = lambda i: F.coalesce(*[F.when(F.col("tipo") == k, v[i]) for k, v in kinds.items()])
    rows = docs.withColumns({"clase": pick(0), "n": order, "q": pick(1)}).where("n <= q")
    return rows.select("slug", "doc_id", F.row_number().over(Window.partitionBy("slug").orderBy("clase", "n")).alias("rango"))


@query("r12_recent_market_days", "SELECT mercado, doc_id, fecha_fin FROM documents WHERE tipo = 'mercado_dia' QUALIFY row_number() OVER (PARTITION BY mercado ORDER BY fecha_fin DESC NULLS LAST, doc_id) <= 3")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy("mercado").orderBy(F.desc_nulls_last("fecha_fin"), "doc_id"))
    return table(spark, d, "documents").where("tipo = 'mercado_dia'").withColumn("k", rank).where("k <= 3").select("mercado", "doc_id", "fecha_fin")


@query("r20_parts", "SELECT doc_id, CASE WHEN tipo <> 'producto_perfil' AND coalesce(fecha_fin < date_trunc('week', (SELECT max(fecha_fin) FROM documents)), FALSE) THEN 'historico' ELSE 'reciente' END AS parte FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "tipo", "fecha_fin")
    rows = docs.crossJoin(F.broadcast(docs.agg(F.max("fecha_fin").alias("_u"))))  # one row
    old = (F.col("tipo") != "producto_perfil") & closed("fecha_fin", F.col("_u"))
    return rows.select("doc_id", F.when(F.coalesce(old, F.lit(False)), "historico").otherwise("reciente").alias("parte"))


@query("r13_hybrid")
def _(spark, d):
    """The query set against the texts: read for products, kinds and dates, searched within them by words and hashed embeddings, with the floor."""
    docs = table(spark, d, "documents")
    names = table(spark, d, "productos").select(slug("nombre_canonico").alias("slug"), F.col("nombre_canonico").alias("nombre")).where("slug IS NOT NULL").dropDuplicates(["slug"])
    return hybrid(docs, names, _asked(docs), table(spark, d, "precios_diarios").agg(F.max("fecha").alias("ultima")))


@query("n13_grounded_numbers")
def _(spark, d):
    """Of the figures of each text, how many its neighbour of the same product states too, and how many follow from two of those by difference or percentage."""
    docs = table(spark, d, "documents").where("slug IS NOT NULL").select("doc_id", "slug", "fecha_inicio", numbers("text").alias("x"))
    before = F.lag("x").over(Window.partitionBy("slug").orderBy("fecha_inicio", "doc_id"))
    rows = docs.withColumn("c", before).where("c IS NOT NULL")
    near = lambda a, b: F.abs(a - b) <= F.greatest(0.01 * F.greatest(F.abs(a), F.lit(1.0)), F.lit(0.005))
    stated = F.filter("x", lambda v: F.exists("c", lambda y: near(v, y)))
    derived = F.filter("x", lambda v: ~F.exists("c", lambda y: near(v, y)) & F.exists("c", lambda a: F.exists("c", lambda b: near(v, F.abs(a - b)) | F.coalesce(near(v, F.abs(100 * F.try_divide(a - b, b))), F.lit(False)))))
    return rows.select("doc_id", F.size("x").alias("cifras"), F.size(stated).alias("en_contexto"), F.size(derived).alias("derivadas"))


@query("f23_hashed_vectors")
def _(spark, d):
    return hashed(table(spark, d, "documents"), "doc_id", "text")


@query("r04_vocabulary", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(strip_accents(coalesce(producto, ''))), '[^a-z0-9]+'), lambda x: x <> ''))) AS token FROM documents) SELECT token, count(*) AS textos FROM t GROUP BY token")
def _(spark: SparkSession, d: str):
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(tokens("producto"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("textos"))


# -- dates, profiles, alignment -----------------------------------------------------------------


@query(
    "s03_dated_links",
    r"""WITH l AS (SELECT regexp_extract(url, '/([^/]+)/[0-9]{4}-[0-9]{2}-[0-9]{2}/', 1) AS fuente, TRY_CAST(regexp_extract(url, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS DATE) AS dia, url FROM fuentes_raw)
 SELECT fuente, dia, min(url) AS url FROM l WHERE dia IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    """The first link of each source and day; impossible days are dropped."""
    found = F.try_to_timestamp(F.regexp_extract("url", "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("yyyy-MM-dd")).cast("date")
    rows = table(spark, d, "fuentes_raw").select(F.regexp_extract("url", "/([^/]+)/[0-9]{4}-[0-9]{2}-[0-9]{2}/", 1).alias("fuente"), found.alias("dia"), "url")
    return rows.where("dia IS NOT NULL").groupBy("fuente", "dia").agg(F.min("url").alias("url"))


@query(
    "l03_relaxed_filter",
    """WITH q AS (SELECT doc_id AS pregunta, slug, fecha_inicio FROM documents WHERE doc_id % 20 = 0 AND slug IS NOT NULL), c AS (SELECT q.pregunta, count(*) FILTER (d.fecha_fin >= q.fecha_inicio AND d.tipo = 'evento_anomalia') AS pasan, count(*) AS todos FROM q JOIN documents d ON d.slug = q.slug GROUP BY ALL)
 SELECT pregunta, CASE WHEN pasan > 0 THEN pasan ELSE todos END AS textos, pasan = 0 AS abierto FROM c""",
)
def _(spark, d):
    """How many texts of the product a question's filter leaves; where it leaves none, it is opened."""
    docs = table(spark, d, "documents").where(F.col("slug").isNotNull())
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("pregunta"), "slug", F.col("fecha_inicio").alias("_f"))
    # Of each product its texts by last day, which the calendar bounds; no question meets single texts.
    events = F.col("tipo") == "evento_anomalia"
    days = docs.groupBy("slug", "fecha_fin").agg(F.count_if(events).alias("e"), F.count("*").alias("t"))
    held = days.groupBy("slug").agg(F.collect_list(F.struct("fecha_fin", "e")).alias("_d"), F.sum("t").alias("t"))
    passing = F.aggregate(F.filter("_d", lambda x: x["fecha_fin"] >= F.col("_f")), F.lit(0).cast("bigint"), lambda s, x: s + x["e"])
    rows = asked.join(held, "slug").withColumn("p", passing)
    return rows.select("pregunta", F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("t")).alias("textos"), (F.col("p") == 0).alias("abierto"))


@query(
    "f15_next_dates",
    f"""WITH {PX}, g AS (SELECT producto_id, mercado_id, fecha, CAST(fecha - lag(fecha) OVER ({W}) AS BIGINT) AS paso FROM px WHERE p IS NOT NULL), s AS (SELECT producto_id, mercado_id, max(fecha) AS ultima, greatest(1, round_even(coalesce(median(paso), 1), 0)) AS paso FROM g GROUP BY ALL)
 SELECT producto_id, mercado_id, ultima, ultima + CAST(paso AS INTEGER) AS h1, ultima + CAST(paso * 7 AS INTEGER) AS h7 FROM s""",
)
def _(spark, d):
    """Where the next and the seventh next observation are due: the last date and the median step."""
    rows = px(spark, d).where("p IS NOT NULL")
    step = windows.median_gap(rows).select(*SERIES, F.greatest(F.lit(1), F.rint(F.coalesce("paso", F.lit(1.0))).cast("int")).alias("k"))
    last = rows.groupBy(*SERIES).agg(F.max("fecha").alias("ultima"))
    return last.join(step, list(SERIES)).select(*SERIES, "ultima", F.date_add("ultima", F.col("k")).alias("h1"), F.date_add("ultima", F.col("k") * 7).alias("h7"))


@query("f31_spans", "SELECT doc_id, CAST(fecha_fin - fecha_inicio AS INTEGER) + 1 AS dias FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.datediff("fecha_fin", "fecha_inicio") + 1).alias("dias"))


@query(
    "c18_range_warnings",
    f"WITH {PX} SELECT mercado_id, count(*) FILTER (p < 2000) AS bajos, count(*) FILTER (p > 600000) AS altos, count(*) FILTER (p IS NULL) AS sin_precio, count(*) FILTER (m IS NULL) AS sin_masa FROM px GROUP BY mercado_id",
)
def _(spark, d):
    checks = {"bajos": F.col("p") < 2000, "altos": F.col("p") > 600000, "sin_precio": F.col("p").isNull(), "sin_masa": F.col("m").isNull()}
    return px(spark, d).groupBy("mercado_id").agg(*[F.count_if(c).alias(n) for n, c in checks.items()])


@query(
    "a08_profiles",
    f"""WITH {PX}, y AS (SELECT producto_id, month(fecha) AS mes, CAST(sum(p) AS DOUBLE) / count(p) AS media FROM px WHERE p IS NOT NULL GROUP BY ALL), t AS (SELECT producto_id, count(*) AS meses, arg_min(mes, media) AS barato, arg_max(mes, media) AS caro FROM y GROUP BY ALL)
 SELECT px.producto_id, min(fecha) AS desde, max(fecha) AS hasta, count(p) AS n, min(p) AS minimo, max(p) AS maximo, count(DISTINCT mercado_id) AS mercados, any_value(CASE WHEN meses >= 6 THEN barato END) AS barato, any_value(CASE WHEN meses >= 6 THEN caro END) AS caro FROM px LEFT JOIN t USING (producto_id) GROUP BY px.producto_id""",
)
def _(spark, d):
    """What a product's profile says: its span, extremes, markets and, from six months on, its cheapest and dearest month."""
    rows = px(spark, d)
    months = rows.where("p IS NOT NULL").groupBy("producto_id", F.month("fecha").alias("mes")).agg((F.sum("p").cast("double") / F.count("p")).alias("v"))
    season = months.groupBy("producto_id").agg(F.count("*").alias("k"), F.min_by("mes", "v").alias("b"), F.max_by("mes", "v").alias("c"))
    out = rows.groupBy("producto_id").agg(F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.count("p").alias("n"), F.min("p").alias("minimo"), F.max("p").alias("maximo"), F.countDistinct("mercado_id").alias("mercados"))
    return out.join(season, "producto_id", "left").select(*out.columns, F.when(F.col("k") >= 6, F.col("b")).alias("barato"), F.when(F.col("k") >= 6, F.col("c")).alias("caro"))


@query(
    "a09_day_facts",
    f"""WITH {PX}, c AS (SELECT *, last_value(p IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, max(fecha) OVER (PARTITION BY mercado_id) AS f1 FROM px), v AS (SELECT *, CAST(floor(CAST(p - q AS DOUBLE) / q * 1e6 + 0.5) AS BIGINT) AS v FROM c WHERE fecha = f1)
 SELECT mercado_id, fecha, sum(m)::BIGINT AS masa, coalesce(array_to_string(list(producto_id ORDER BY v DESC, producto_id) FILTER (v > 0)[1:3], ' '), '') AS suben, coalesce(array_to_string(list(producto_id ORDER BY v, producto_id) FILTER (v < 0)[1:3], ' '), '') AS bajan FROM v GROUP BY ALL""",
)
def _(spark, d):
    """The last day of each market: its mass, and the three products that rose and fell most."""
    rows = px(spark, d).withColumns({"c": windows.change("p"), "_f": F.max("fecha").over(Window.partitionBy("mercado_id"))}).where("fecha = _f")
    rows = rows.withColumn("v", F.floor(F.col("c") * 1e6 + 0.5).cast("bigint"))
    three = lambda ok, by: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(ok, F.struct(by.alias("o"), "producto_id")))), 1, 3), lambda x: x["producto_id"].cast("string")), " ")
    return rows.groupBy("mercado_id", "fecha").agg(F.sum("m").alias("masa"), three(F.col("v") > 0, -F.col("v")).alias("suben"), three(F.col("v") < 0, F.col("v")).alias("bajan"))


@query(
    "j11_aligned",
    f"""WITH {PX}, d AS (SELECT mercado_id, fecha FROM (SELECT DISTINCT mercado_id, fecha FROM px) QUALIFY row_number() OVER (PARTITION BY mercado_id ORDER BY fecha DESC) <= 30), s AS (SELECT DISTINCT mercado_id, producto_id FROM px)
 SELECT d.mercado_id, d.fecha, s.producto_id, px.p FROM d JOIN s USING (mercado_id) LEFT JOIN px ON px.mercado_id = d.mercado_id AND px.fecha = d.fecha AND px.producto_id = s.producto_id""",
)
def _(spark, d):
    """The products of a market side by side on the union of their last thirty dates, null where one has none."""
    rows = px(spark, d).select(*KEY, "p")
    rank = F.row_number().over(Window.partitionBy("mercado_id").orderBy(F.desc("fecha")))
    days = rows.select("mercado_id", "fecha").distinct().withColumn("k", rank).where("k <= 30").drop("k")
    return days.join(rows.select("mercado_id", "producto_id").distinct(), "mercado_id").join(rows, ["mercado_id", "fecha", "producto_id"], "left")


@query(
    "w27_axes",
    f"""WITH {PX}, a AS (SELECT mercado_id, min(p) AS lo, max(p) AS hi FROM px WHERE p IS NOT NULL GROUP BY ALL) SELECT mercado_id, greatest(0, lo - CASE WHEN hi = lo THEN 5000 ELSE (hi - lo) * 12 // 100 END) AS desde, hi + CASE WHEN hi = lo THEN 5000 ELSE (hi - lo) * 12 // 100 END AS hasta FROM a""",
)
def _(spark, d):
    """The range of a chart over all series of a market, with a margin of 12 %."""
    rows = px(spark, d).groupBy("mercado_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo IS NOT NULL")
    pad = F.when(F.col("hi") == F.col("lo"), 5000).otherwise(F.floor((F.col("hi") - F.col("lo")) * 12 / 100))
    return rows.select("mercado_id", F.greatest(F.lit(0), F.col("lo") - pad).alias("desde"), (F.col("hi") + pad).alias("hasta"))


@query("k02_extremes", f"WITH {PX}, k AS (SELECT mercado_id, producto_id, p, row_number() OVER (PARTITION BY mercado_id ORDER BY p, producto_id) AS barato, row_number() OVER (PARTITION BY mercado_id ORDER BY p DESC, producto_id) AS caro FROM px WHERE p IS NOT NULL AND fecha = (SELECT max(fecha) FROM px x WHERE x.mercado_id = px.mercado_id AND x.p IS NOT NULL)) SELECT mercado_id, producto_id, p FROM k WHERE barato <= 3 OR caro <= 3")
def _(spark, d):
    """The three cheapest and dearest products of each market on the last day with prices."""
    rows = px(spark, d).where("p IS NOT NULL")
    last = rows.groupBy("mercado_id").agg(F.max("fecha").alias("fecha"))
    own = Window.partitionBy("mercado_id")
    ranked = rows.join(last, ["mercado_id", "fecha"]).withColumns({"a": F.row_number().over(own.orderBy("p", "producto_id")), "z": F.row_number().over(own.orderBy(F.desc("p"), "producto_id"))})
    return ranked.where("a <= 3 OR z <= 3").select("mercado_id", "producto_id", "p")
