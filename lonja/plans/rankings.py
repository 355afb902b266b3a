"""Queries of rankings, comparisons, joins and summaries over the price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.calendar import period
from lonja.functions.questions import STOP
from lonja.functions.text import normalised, slug
from lonja.operators import index, joins, retrieval, windows
from lonja.operators.series import SERIES, merged
from lonja.plans.general import KEY
from lonja.plans.reference import _ASKED, _BM25, _KNN, _MAE, _RETURNS, METHODS, PX, W, _asked, _sql_list, _walk_sql, _Z, px, returns
from lonja.plans.registry import registry
from lonja.session import table

QUERIES, SQL, query = registry()

# -- rankings -----------------------------------------------------------------------------------


def _ranked(df: DataFrame, of: list[str], up: str = "v") -> DataFrame:
    """alza, baja: place among the risers and the fallers of each group, ties by product."""
    own = Window.partitionBy(*of)
    return df.withColumns({"alza": F.row_number().over(own.orderBy(F.desc(up), "producto_id")), "baja": F.row_number().over(own.orderBy(up, "producto_id"))})


_UPDOWN = "row_number() OVER (PARTITION BY {0} ORDER BY v DESC, producto_id) AS alza, row_number() OVER (PARTITION BY {0} ORDER BY v, producto_id) AS baja"


@query("k01_both_ways", f"WITH {PX}, {_RETURNS}, k AS (SELECT *, {_UPDOWN.format('mercado_id, fecha')} FROM r) SELECT mercado_id, fecha, producto_id, v, alza, baja FROM k WHERE alza <= 6 OR baja <= 6")
def _(spark, d):
    """The six that rose and the six that fell most, of each market and day, without a filter of sign."""
    return _ranked(returns(spark, d), ["mercado_id", "fecha"]).where("alza <= 6 OR baja <= 6").select("mercado_id", "fecha", "producto_id", "v", "alza", "baja")


@query(
    "k02_all_extremes",
    f"""WITH {PX}, {_RETURNS}, u AS (SELECT px.mercado_id, px.producto_id, p, v FROM px LEFT JOIN r USING (producto_id, mercado_id, fecha) WHERE fecha = (SELECT max(fecha) FROM px x WHERE x.mercado_id = px.mercado_id) AND p IS NOT NULL),
 l AS (SELECT 'barato' AS lista, mercado_id, producto_id, p, row_number() OVER (PARTITION BY mercado_id ORDER BY p, producto_id) AS rango FROM u UNION ALL SELECT 'caro', mercado_id, producto_id, p, row_number() OVER (PARTITION BY mercado_id ORDER BY p DESC, producto_id) FROM u
 UNION ALL SELECT 'alza', mercado_id, producto_id, p, row_number() OVER (PARTITION BY mercado_id ORDER BY v DESC, producto_id) FROM u WHERE v > 0 UNION ALL SELECT 'baja', mercado_id, producto_id, p, row_number() OVER (PARTITION BY mercado_id ORDER BY v, producto_id) FROM u WHERE v < 0) SELECT * FROM l WHERE rango <= 5""",
)
def extremes(spark, d):
    """The five cheapest, dearest, most risen and most fallen products of each market's last day; only rises rise, only falls fall."""
    rows = px(spark, d).withColumn("v", F.floor(windows.change("p") * 1e6 + 0.5).cast("bigint"))
    last = rows.groupBy("mercado_id").agg(F.max("fecha").alias("fecha"))
    u = rows.join(last, ["mercado_id", "fecha"]).where("p IS NOT NULL")
    lists = {"barato": (F.lit(True), F.col("p")), "caro": (F.lit(True), -F.col("p")), "alza": (F.col("v") > 0, -F.col("v")), "baja": (F.col("v") < 0, F.col("v"))}
    # Each product stands in up to four lists; a market's products of one day are few, the list is a dimension.
    places = F.explode(F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(n).alias("lista"), by.alias("o"))) for n, (ok, by) in lists.items()])))
    flat = u.select("mercado_id", "producto_id", "p", places.alias("x")).select("x.lista", "x.o", "mercado_id", "producto_id", "p")
    rank = F.row_number().over(Window.partitionBy("lista", "mercado_id").orderBy("o", "producto_id"))
    return flat.withColumn("rango", rank).where("rango <= 5").select("lista", "mercado_id", "producto_id", "p", "rango")


@query(
    "k03_tables",
    f"WITH {PX}, l AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1) SELECT mercado_id, nombre_canonico AS nombre, p, row_number() OVER (PARTITION BY mercado_id ORDER BY lower(strip_accents(nombre_canonico)), nombre_canonico) AS lugar FROM l JOIN productos ON productos.id = producto_id",
)
def _(spark, d):
    """Each market's products in the order of their names, accents and case apart."""
    last = windows.latest(px(spark, d).select(*KEY, "p")).join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), F.col("nombre_canonico").alias("nombre")), "producto_id")
    place = F.row_number().over(Window.partitionBy("mercado_id").orderBy(normalised("nombre"), "nombre"))
    return last.select("mercado_id", "nombre", "p", place.alias("lugar"))


@query(
    "k05_null_order",
    f"""WITH {PX}, l AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1)
 SELECT mercado_id, producto_id, row_number() OVER (PARTITION BY mercado_id ORDER BY p ASC NULLS FIRST, producto_id) AS sube, row_number() OVER (PARTITION BY mercado_id ORDER BY p DESC NULLS LAST, producto_id) AS baja FROM l""",
)
def _(spark, d):
    """A missing price is the least of all, whichever way a table is sorted."""
    own = Window.partitionBy("mercado_id")
    last = windows.latest(px(spark, d).select(*KEY, "p"))
    return last.select("mercado_id", "producto_id", F.row_number().over(own.orderBy(F.asc_nulls_first("p"), "producto_id")).alias("sube"), F.row_number().over(own.orderBy(F.desc_nulls_last("p"), "producto_id")).alias("baja"))


@query(
    "k07_verified",
    f"""WITH {PX}, l AS (SELECT * FROM px WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1), g AS (SELECT producto_id, p AS g FROM l JOIN mercados ON id = mercado_id WHERE codigo = 'GMML'),
 d AS (SELECT l.producto_id, l.mercado_id, CAST(floor(CAST(p - g AS DOUBLE) / g * 1e6 + 0.5) AS BIGINT) AS delta FROM l JOIN mercados ON id = mercado_id JOIN g USING (producto_id) WHERE codigo <> 'GMML')
 SELECT *, row_number() OVER (PARTITION BY mercado_id ORDER BY abs(delta) DESC, producto_id) AS rango FROM d""",
)
def _(spark, d):
    """What both the main market and another one price, by how far they are apart."""
    last = windows.latest(px(spark, d).where("p IS NOT NULL").select(*KEY, "p")).join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")
    main = last.where("codigo = 'GMML'").select("producto_id", F.col("p").alias("g"))
    delta = F.floor((F.col("p") - F.col("g")).cast("double") / F.col("g") * 1e6 + 0.5).cast("bigint")
    rows = last.where("codigo <> 'GMML'").join(main, "producto_id").select(*SERIES, delta.alias("delta"))
    return rows.withColumn("rango", F.row_number().over(Window.partitionBy("mercado_id").orderBy(F.desc(F.abs("delta")), "producto_id")))


#: The words by which a question asks for a list, in the order they are looked for.
INTENTS = {"caro": "mas caro|mayor precio|mas alto", "barato": "mas barato|menor precio|mas bajo", "alza": "alza|subi", "baja": "baja|bajo|bajaron"}
ASKED = ("¿qué está más barato hoy?", "lo MÁS CARO del mercado", "¿qué subió?", "¿qué productos bajaron?", "hola")


def intent(question):
    """The list that a question asks for; null for none."""
    t = normalised(question)
    out = F.lit(None).cast("string")
    for name, words in reversed(INTENTS.items()):
        out = F.when(t.rlike(words), name).otherwise(out)
    return out


@query("k10_keywords", SQL["k02_all_extremes"].replace("SELECT * FROM l WHERE rango <= 5", ", q AS (SELECT * FROM (VALUES ('¿qué está más barato hoy?', 'barato'), ('lo MÁS CARO del mercado', 'caro'), ('¿qué subió?', 'alza'), ('¿qué productos bajaron?', 'baja')) t(pregunta, lista)) SELECT pregunta, mercado_id, producto_id, p, rango FROM l JOIN q USING (lista) WHERE rango <= 5"))
def _(spark, d):
    """What questions of a few known words are answered with, without a language model."""
    asked = spark.createDataFrame([(q,) for q in ASKED], "pregunta string").withColumn("lista", intent("pregunta"))
    return extremes(spark, d).join(asked.where("lista IS NOT NULL"), "lista").select("pregunta", "mercado_id", "producto_id", "p", "rango")


_LAST_DAY = f"WITH {PX}, u AS (SELECT * FROM px WHERE fecha = (SELECT max(fecha) FROM px))"


@query(
    "k11_lists",
    f"""{_LAST_DAY}, l AS (SELECT 'caro' AS lista, producto_id, mercado_id, p AS v, row_number() OVER (ORDER BY p DESC, producto_id, mercado_id) AS rango FROM u WHERE p IS NOT NULL UNION ALL SELECT 'barato', producto_id, mercado_id, p, row_number() OVER (ORDER BY p, producto_id, mercado_id) FROM u WHERE p IS NOT NULL
 UNION ALL SELECT 'ingreso', producto_id, mercado_id, m, row_number() OVER (ORDER BY m DESC, producto_id, mercado_id) FROM u WHERE m IS NOT NULL UNION ALL SELECT 'alza', producto_id, mercado_id, p, row_number() OVER (ORDER BY producto_id, mercado_id) FROM u WHERE tendencia = 'En Alza' UNION ALL SELECT 'todo', producto_id, mercado_id, p, row_number() OVER (ORDER BY producto_id, mercado_id) FROM u) SELECT * FROM l WHERE rango <= 10""",
)
def _(spark, d):
    """Ten rows of the last day for each kind of question that a ready statement answers."""
    rows = px(spark, d)
    u = rows.join(F.broadcast(rows.agg(F.max("fecha").alias("fecha"))), "fecha")  # one date
    lists = {"caro": ("p IS NOT NULL", "p", [F.desc("p")]), "barato": ("p IS NOT NULL", "p", ["p"]), "ingreso": ("m IS NOT NULL", "m", [F.desc("m")]), "alza": ("tendencia = 'En Alza'", "p", []), "todo": ("TRUE", "p", [])}
    out = None
    for name, (where, value, by) in lists.items():
        top = u.where(where).orderBy(*by, *SERIES).limit(10)  # taken in every task before they meet
        part = top.select(F.lit(name).alias("lista"), *SERIES, F.col(value).alias("v"), F.row_number().over(Window.orderBy(*by, *SERIES)).alias("rango"))
        out = part if out is None else out.unionByName(part)
    return out


_BOTH = f"{_Z}, w AS (SELECT producto_id, mercado_id, fecha, m AS p FROM px), {_Z.replace('FROM px', 'FROM w').replace('v AS (', 'v2 AS (').replace('FROM v)', 'FROM v2)').replace('c AS (', 'c2 AS (').replace('FROM c)', 'FROM c2)').replace('d AS (', 'd2 AS (').replace('FROM d)', 'FROM d2)').replace('z AS (', 'z2 AS (')}, a AS (SELECT producto_id, mercado_id, fecha, 'precio' AS tipo, p AS valor, z FROM z UNION ALL SELECT producto_id, mercado_id, fecha, 'volumen', p, z FROM z2)"


@query("w06_all_anomalies", f"WITH {PX}, {_BOTH} SELECT producto_id, mercado_id, fecha, tipo, valor, floor(z * 1e6 + 0.5) AS z FROM a WHERE abs(z) >= 3.5")
def _(spark, d):
    """Prices and masses far from the history of their series."""
    hot = windows.anomalies(px(spark, d), {"precio": "p", "volumen": "m"})
    return hot.select(*KEY, "tipo", "valor", F.floor(F.col("z") * 1e6 + 0.5).cast("double").alias("z"))


@query(
    "k04_top_anomalies",
    f"WITH {PX}, {_BOTH}, u AS (SELECT a.*, max(fecha) OVER (PARTITION BY producto_id, mercado_id, tipo) AS f FROM a WHERE valor IS NOT NULL) SELECT mercado_id, producto_id, tipo, fecha, row_number() OVER (PARTITION BY mercado_id ORDER BY floor(abs(z) * 1e6 + 0.5) DESC, producto_id, tipo) AS rango FROM u WHERE abs(z) >= 3.5 AND fecha = f",
)
def _(spark, d):
    """The last values of each market that are far from their history, the furthest first."""
    rows = px(spark, d)
    hot = windows.anomalies(rows, {"precio": "p", "volumen": "m"})
    ends = [rows.where(F.col(c).isNotNull()).groupBy(*SERIES).agg(F.max("fecha").alias("fecha")).withColumn("tipo", F.lit(n)) for n, c in (("precio", "p"), ("volumen", "m"))]
    last = hot.join(ends[0].unionByName(ends[1]), [*SERIES, "tipo", "fecha"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("mercado_id").orderBy(F.desc(F.floor(F.abs("z") * 1e6 + 0.5)), "producto_id", "tipo"))
    return last.select("mercado_id", "producto_id", "tipo", "fecha", rank.alias("rango"))


# -- joins --------------------------------------------------------------------------------------


@query(
    "j06_attached",
    f"WITH {PX}, {_walk_sql(1)}, {_MAE}, b AS (SELECT * FROM mae QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY mae, metodo) = 1), l AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1) SELECT l.producto_id, l.mercado_id, l.fecha, l.p, b.metodo, b.mae FROM l LEFT JOIN b USING (producto_id, mercado_id)",
)
def _(spark, d):
    """The last row of each series with the method that forecasts it best; series without one stay."""
    rows = px(spark, d)
    best = windows.walk_forward(windows.forecasts(rows, "p"), METHODS).groupBy(*SERIES).agg(F.min(F.struct("mae", "metodo")).alias("b"))
    return windows.latest(rows.select(*KEY, "p")).join(best, list(SERIES), "left").select(*KEY, "p", "b.metodo", "b.mae")


@query(
    "j08_anomalies_in_weeks",
    f"WITH {PX}, {_Z}, s AS (SELECT producto_id, mercado_id, printf('%d-W%02d', isoyear(fecha), week(fecha)) AS semana, count(p) AS n, min(p) AS minimo, max(p) AS maximo FROM px GROUP BY ALL) SELECT z.producto_id, z.mercado_id, z.fecha, z.p, s.semana, n, minimo, maximo FROM z JOIN s ON s.producto_id = z.producto_id AND s.mercado_id = z.mercado_id AND s.semana = printf('%d-W%02d', isoyear(z.fecha), week(z.fecha)) WHERE abs(z) >= 3.5",
)
def _(spark, d):
    """Each anomaly of a price with the week that it falls into."""
    rows = px(spark, d)
    weeks = rows.groupBy(*SERIES, period("fecha", "semana").alias("semana")).agg(F.count("p").alias("n"), F.min("p").alias("minimo"), F.max("p").alias("maximo"))
    hot = windows.robust_z(rows, "p").where("abs(z) >= 3.5").withColumn("semana", period("fecha", "semana"))
    return hot.join(weeks, [*SERIES, "semana"]).select(*KEY, "p", "semana", "n", "minimo", "maximo")


_SLUG = "trim(lower(regexp_replace(strip_accents(nombre_canonico), '[^a-zA-Z0-9]+', '-', 'g')), '-')"


@query(
    "j14_in_given_order",
    f"""WITH q AS (SELECT doc_id AS pregunta, unnest(list_reverse(string_split(slug || '|nada|' || slug || '|papa', '|'))) AS slug, generate_subscripts(string_split(slug || '|nada|' || slug || '|papa', '|'), 1) - 1 AS i FROM documents WHERE doc_id % 20 = 0 AND slug IS NOT NULL),
 p AS (SELECT {_SLUG} AS slug, min(id) AS id FROM productos WHERE nombre_canonico IS NOT NULL GROUP BY 1), j AS (SELECT pregunta, id, min(i) AS i FROM q JOIN p USING (slug) GROUP BY ALL) SELECT pregunta, id, row_number() OVER (PARTITION BY pregunta ORDER BY i) AS lugar FROM j""",
)
def _(spark, d):
    """The products of a list of slugs in the order of the list; unknown ones drop out, repeated ones count once, eight at most."""
    docs = table(spark, d, "documents").where("doc_id % 20 = 0 AND slug IS NOT NULL")
    asked = docs.select(F.col("doc_id").alias("pregunta"), F.posexplode(F.reverse(F.array("slug", F.lit("nada"), "slug", F.lit("papa")))).alias("i", "slug"))
    names = table(spark, d, "productos").where("nombre_canonico IS NOT NULL").groupBy(slug("nombre_canonico").alias("slug")).agg(F.min("id").alias("id"))
    return joins.in_order(asked, names, "pregunta", "i", "slug", ["id"], most=8)


@query("j15_not_embedded", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.lang IS NOT NULL AND k.doc_id = d.doc_id)")
def _(spark, d):
    """The texts whose vector is not kept yet; here those without a language are taken as new."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    known = docs.where("lang IS NOT NULL").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("huella"))
    return index.missing(docs, known, "doc_id", "text").select("doc_id")


@query(
    "j20_merged",
    f"WITH {PX}, a AS (SELECT producto_id, mercado_id, count(p) AS precios FROM px GROUP BY ALL), b AS (SELECT producto_id, mercado_id, max(fecha) AS ultima FROM px WHERE tendencia = 'En Alza' GROUP BY ALL), c AS (SELECT producto_id, mercado_id, sum(m)::BIGINT AS masa FROM px WHERE m > 1000 GROUP BY ALL) SELECT * FROM a FULL JOIN b USING (producto_id, mercado_id) FULL JOIN c USING (producto_id, mercado_id)",
)
def _(spark, d):
    """Partial results of the series put together by series; what a part lacks is null."""
    rows = px(spark, d)
    parts = [rows.groupBy(*SERIES).agg(F.count("p").alias("precios")), rows.where("tendencia = 'En Alza'").groupBy(*SERIES).agg(F.max("fecha").alias("ultima")), rows.where("m > 1000").groupBy(*SERIES).agg(F.sum("m").alias("masa"))]
    return merged(parts, SERIES)


# -- filters ------------------------------------------------------------------------------------


@query(
    "l08_main_market",
    f"WITH {PX}, k AS (SELECT 'GMML' AS pedido, count(*) AS n FROM px JOIN mercados ON id = mercado_id WHERE codigo = 'GMML'), e AS (SELECT count(*) AS n FROM px) SELECT 'GMML' AS pedido, CASE WHEN k.n > 0 THEN k.n ELSE e.n END AS filas FROM k, e WHERE e.n > 0 UNION ALL SELECT 'NADIE', n FROM e WHERE n > 0",
)
def _(spark, d):
    """The rows of a main market; all rows where there is no such market."""
    markets = table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo")
    rows = px(spark, d)
    counts = [windows.of_market(rows, markets, c).select(F.lit(c).alias("pedido")) for c in ("GMML", "NADIE")]
    return counts[0].unionByName(counts[1]).groupBy("pedido").agg(F.count("*").alias("filas"))


@query("l13_further_markets", f"WITH {PX} SELECT mercado_id, codigo, count(*) AS productos FROM px JOIN mercados ON id = mercado_id WHERE codigo <> 'GMML' AND p IS NOT NULL AND fecha = (SELECT max(fecha) FROM px x WHERE x.mercado_id = px.mercado_id) GROUP BY ALL")
def _(spark, d):
    """The other markets that have a price on their last day."""
    rows = px(spark, d)
    last = rows.groupBy("mercado_id").agg(F.max("fecha").alias("fecha"))
    markets = table(spark, d, "mercados").where("codigo <> 'GMML'").select(F.col("id").alias("mercado_id"), "codigo")
    return rows.where("p IS NOT NULL").join(last, ["mercado_id", "fecha"]).join(markets, "mercado_id").groupBy("mercado_id", "codigo").agg(F.count("*").alias("productos"))


@query("l14_between", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p FROM px WHERE fecha BETWEEN DATE '2024-06-01' AND DATE '2024-06-30' AND p IS NOT NULL")
def _(spark, d):
    return px(spark, d).where("fecha BETWEEN DATE '2024-06-01' AND DATE '2024-06-30' AND p IS NOT NULL").select(*KEY, "p")


@query(
    "l16_long_enough",
    f"WITH {PX} SELECT producto_id, mercado_id, count(p) >= 90 AS pronostico, count(p) >= 120 AS arboles, count(m) >= 90 AS volumen FROM px GROUP BY ALL",
)
def _(spark, d):
    """Which series have the history that forecasts, trees and the volume gate ask for."""
    return px(spark, d).groupBy(*SERIES).agg((F.count("p") >= 90).alias("pronostico"), (F.count("p") >= 120).alias("arboles"), (F.count("m") >= 90).alias("volumen"))


@query(
    "l17_gold_matches",
    """WITH g AS (SELECT doc_id AS caso, slug, CASE WHEN tipo <> 'producto_perfil' THEN tipo END AS tipo, fecha_inicio AS dia, producto AS contiene FROM documents WHERE doc_id % 20 = 0 AND slug IS NOT NULL)
 SELECT caso, count(*) AS textos, min(d.doc_id) AS primero FROM g JOIN documents d ON d.slug = g.slug WHERE (g.tipo IS NULL OR d.tipo = g.tipo) AND (g.dia IS NULL OR (d.fecha_inicio <= g.dia AND d.fecha_fin >= g.dia)) AND (g.contiene IS NULL OR contains(lower(strip_accents(d.text)), lower(strip_accents(g.contiene)))) GROUP BY caso""",
)
def _(spark, d):
    """The texts that cases of a gold set accept: product, kind, a day within, words within; what a case leaves open passes."""
    docs = table(spark, d, "documents")
    gold = docs.where("doc_id % 20 = 0 AND slug IS NOT NULL").select(F.col("doc_id").alias("caso"), "slug", F.when(F.col("tipo") != "producto_perfil", F.col("tipo")).alias("_tipo"), F.col("fecha_inicio").alias("_dia"), F.col("producto").alias("_contiene"))
    # Cases that ask the same are put once: of what can be asked about a product there is no more than kinds and days.
    asks = gold.select("caso", F.to_json(F.struct("slug", "_tipo", "_dia", "_contiene")).alias("_k"), "slug", "_tipo", "_dia", "_contiene")
    once = asks.drop("caso").distinct()
    found = retrieval.accepted(docs.select("doc_id", "slug", "tipo", "fecha_inicio", "fecha_fin", "text"), once, "slug").groupBy("_k").agg(F.count("*").alias("textos"), F.min("doc_id").alias("primero"))
    return asks.select("caso", "_k").join(found, "_k").drop("_k")


# -- summaries ----------------------------------------------------------------------------------


@query("a10_facts", f"WITH {PX} SELECT codigo AS mercado, max(fecha) AS ultima, sum(m)::BIGINT AS masa, count(*) AS filas, count(DISTINCT producto_id) AS productos FROM px JOIN mercados ON id = mercado_id GROUP BY codigo")
def _(spark, d):
    rows = px(spark, d).join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), F.col("codigo").alias("mercado")), "mercado_id")
    return rows.groupBy("mercado").agg(F.max("fecha").alias("ultima"), F.sum("m").alias("masa"), F.count("*").alias("filas"), F.countDistinct("producto_id").alias("productos"))


@query(
    "a13_check_summary",
    f"""WITH {PX}, a AS (SELECT producto_id, fecha, p AS g FROM px JOIN mercados ON id = mercado_id WHERE codigo = 'GMML' AND p IS NOT NULL), c AS (SELECT px.mercado_id, CASE WHEN g IS NULL THEN NULL ELSE abs(CAST(p - g AS DOUBLE) / g) <= 0.15 END AS coincide FROM px JOIN mercados ON id = mercado_id LEFT JOIN a USING (producto_id, fecha) WHERE codigo <> 'GMML' AND p IS NOT NULL)
 SELECT mercado_id, count(*) AS n, count(*) FILTER (coincide) AS coinciden, count(coincide) AS comparados, bool_or(coincide IS NOT NULL) AS alguno FROM c GROUP BY mercado_id""",
)
def _(spark, d):
    """How often each market agrees with the main one within 15 %."""
    rows = px(spark, d).where("p IS NOT NULL").join(table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")
    main = rows.where("codigo = 'GMML'").select("producto_id", "fecha", F.col("p").alias("g"))
    both = rows.where("codigo <> 'GMML'").join(main, ["producto_id", "fecha"], "left").withColumn("c", F.abs(F.try_divide((F.col("p") - F.col("g")).cast("double"), F.col("g").cast("double"))) <= 0.15)
    return both.groupBy("mercado_id").agg(F.count("*").alias("n"), F.count_if("c").alias("coinciden"), F.count("c").alias("comparados"), F.bool_or(F.col("c").isNotNull()).alias("alguno"))


@query(
    "a16_ranking",
    f"""WITH {PX}, {_walk_sql(1)}, {_MAE}, c AS (SELECT producto_id, mercado_id FROM mae GROUP BY ALL HAVING count(*) = 3), m AS (SELECT metodo, CAST(sum(CAST(floor(mae * 1000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS mae FROM mae JOIN c USING (producto_id, mercado_id) GROUP BY metodo)
 SELECT metodo, mae, floor((b - mae) / b * 1e6 + 0.5) AS mejora, row_number() OVER (ORDER BY mae, metodo) AS rango FROM m, (SELECT mae AS b FROM m WHERE metodo = 'estacional')""",
)
def _(spark, d):
    """The methods by their mean error, with what they gain on the seasonal one, also where that is a loss."""
    mae = windows.walk_forward(windows.forecasts(px(spark, d), "p"), METHODS)
    rows = mae.withColumn("c", F.count("*").over(Window.partitionBy(*SERIES))).where("c = 3")
    m = rows.groupBy("metodo").agg((F.sum(F.floor(F.col("mae") * 1000 + 0.5).cast("bigint")).cast("double") / F.count("*") / 1000).alias("mae"))
    one = Window.partitionBy(F.lit(1))  # three rows
    base = F.max(F.when(F.col("metodo") == "estacional", F.col("mae"))).over(one)
    return m.select("metodo", "mae", F.floor((base - F.col("mae")) / base * 1e6 + 0.5).cast("double").alias("mejora"), F.row_number().over(one.orderBy("mae", "metodo")).alias("rango"))


@query("a20_dates", f"WITH {PX} SELECT count(DISTINCT fecha) AS fechas, count(DISTINCT strftime(fecha, '%Y-%m')) AS meses, count(DISTINCT producto_id) AS productos FROM px")
def _(spark, d):
    return px(spark, d).agg(F.countDistinct("fecha").alias("fechas"), F.countDistinct(F.date_format("fecha", "yyyy-MM")).alias("meses"), F.countDistinct("producto_id").alias("productos"))


@query("a22_runs", "SELECT fuente, count(*) AS entregas, count(*) FILTER (fecha IS NOT NULL AND n_filas >= 8) AS cargadas, count(*) FILTER (fecha IS NULL OR n_filas < 8) AS bloqueadas, max(fecha) AS ultima FROM (SELECT DISTINCT reporte_id, fuente, fecha, n_filas FROM reportes) GROUP BY fuente")
def _(spark, d):
    """What a run over the deliveries of each source did: how many were loaded, how many held back, and the last day."""
    rows = table(spark, d, "reportes").select("reporte_id", "fuente", "fecha", "n_filas").distinct()
    ok = F.col("fecha").isNotNull() & (F.col("n_filas") >= 8)
    return rows.groupBy("fuente").agg(F.count("*").alias("entregas"), F.count_if(ok).alias("cargadas"), F.count_if(F.col("fecha").isNull() | (F.col("n_filas") < 8)).alias("bloqueadas"), F.max("fecha").alias("ultima"))


@query(
    "a06_day_movers",
    f"""WITH {PX}, {_RETURNS}, k AS (SELECT *, {_UPDOWN.format('mercado_id, fecha')} FROM r) SELECT mercado_id, fecha, coalesce(string_agg(CAST(producto_id AS VARCHAR), ' ' ORDER BY alza) FILTER (alza <= 5 AND v > 0), '') AS suben, coalesce(string_agg(CAST(producto_id AS VARCHAR), ' ' ORDER BY baja) FILTER (baja <= 5 AND v < 0), '') AS bajan FROM k GROUP BY ALL""",
)
def _(spark, d):
    """The five products that rose and fell most on each day of each market, none that did the opposite."""
    rows = returns(spark, d)
    five = lambda ok, by: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(ok, F.struct(by.alias("o"), "producto_id")))), 1, 5), lambda x: x["producto_id"].cast("string")), " ")
    return rows.groupBy("mercado_id", "fecha").agg(five(F.col("v") > 0, -F.col("v")).alias("suben"), five(F.col("v") < 0, F.col("v")).alias("bajan"))


# -- windows ------------------------------------------------------------------------------------


@query("w04_period_change", f"WITH {PX} SELECT producto_id, mercado_id, strftime(fecha, '%Y-%m') AS mes, CAST(floor(CAST(arg_max(p, fecha) - arg_min(p, fecha) AS DOUBLE) / arg_min(p, fecha) * 1e6 + 0.5) AS BIGINT) AS cambio FROM px WHERE p IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def _(spark, d):
    """From the first to the last price of each month, where there are two."""
    g = px(spark, d).where("p IS NOT NULL").groupBy(*SERIES, period("fecha", "mes").alias("mes")).agg(F.min_by("p", "fecha").alias("a"), F.max_by("p", "fecha").alias("z"), F.count("*").alias("n"))
    return g.where("n >= 2").select(*SERIES, "mes", F.floor((F.col("z") - F.col("a")).cast("double") / F.col("a") * 1e6 + 0.5).cast("bigint").alias("cambio"))


@query(
    "w22_evenly",
    f"WITH {PX}, k AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY producto_id, mercado_id) AS n FROM px) SELECT producto_id, mercado_id, fecha, p FROM k WHERE n <= 60 OR i = n - 1 OR list_contains(list_transform(range(59), lambda j: j * n // 60), i)",
)
def _(spark, d):
    """Sixty rows of each series, evenly spread, the last of them its last."""
    return windows.evenly(px(spark, d).select(*KEY, "p"), 60)


@query("w22_last", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p FROM px QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) <= 20")
def _(spark, d):
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("fecha")))
    return px(spark, d).select(*KEY, "p").withColumn("k", rank).where("k <= 20").drop("k")


@query(
    "w26_closest_five",
    f"""WITH {PX}, {_RETURNS}, s AS (SELECT x.mercado_id, x.producto_id AS a, y.producto_id AS b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x.v) AS DOUBLE) AS sa, CAST(sum(y.v) AS DOUBLE) AS sb, CAST(sum(x.v * x.v) AS DOUBLE) AS saa, CAST(sum(y.v * y.v) AS DOUBLE) AS sbb, CAST(sum(x.v * y.v) AS DOUBLE) AS sab
 FROM r x JOIN r y ON x.mercado_id = y.mercado_id AND x.fecha = y.fecha AND x.producto_id <> y.producto_id GROUP BY ALL), c AS (SELECT mercado_id, a, b, n, CASE WHEN sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) <> 0 THEN floor((n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) * 1e6 + 0.5) END AS r FROM s WHERE n >= 60)
 SELECT mercado_id, a AS producto_id, b AS con, CAST(n AS BIGINT) AS n, r FROM c WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mercado_id, a ORDER BY abs(r) DESC, b) <= 5""",
)
def _(spark, d):
    """The five products whose changes go most with those of each product, over sixty common days at least."""
    found = joins.correlations(returns(spark, d), "mercado_id", "fecha", "producto_id", "v", least=60).withColumn("r", F.floor(F.col("r") * 1e6 + 0.5).cast("double")).where("r IS NOT NULL")
    both = found.select("mercado_id", F.col("a").alias("producto_id"), F.col("b").alias("con"), "n", "r").unionByName(found.select("mercado_id", F.col("b").alias("producto_id"), F.col("a").alias("con"), "n", "r"))
    rank = F.row_number().over(Window.partitionBy("mercado_id", "producto_id").orderBy(F.desc(F.abs("r")), "con"))
    return both.withColumn("k", rank).where("k <= 5").drop("k")


# -- retrieval ----------------------------------------------------------------------------------


@query(
    "r05_bm25_allowed",
    f"WITH {_BM25}, k AS (SELECT bs.pregunta, bs.doc_id, s, row_number() OVER (PARTITION BY bs.pregunta ORDER BY s DESC, bs.doc_id) AS rango FROM bs JOIN documents d ON d.doc_id = bs.doc_id WHERE d.tipo = 'producto_periodo') SELECT pregunta, doc_id, CAST(s AS DOUBLE) / 1e9 AS bm25, rango FROM k WHERE rango <= 10",
)
def _(spark, d):
    """The search by words among an allowed set; how rare a word is stays that of all texts."""
    docs = table(spark, d, "documents")
    allowed = docs.where("tipo = 'producto_periodo'").select("doc_id")
    return retrieval.bm25(docs.select("doc_id", "text"), _asked(docs), "doc_id", "text", "pregunta", "texto", allowed=lambda hits: hits.join(allowed, "doc_id", "left_semi"))


@query("r06_nearest_filtered", f"WITH {_KNN.replace('WHERE q.vec_id % 20 = 0', 'WHERE q.vec_id % 20 = 0 AND e.label <> q.label')} SELECT * FROM n")
def _(spark, d):
    """The nearest vectors of other labels: what is filtered out is never ranked."""
    e = table(spark, d, "embeddings").withColumns({"slug": F.col("label").cast("string"), "tipo": F.lit("v"), "fecha_inicio": F.lit(None).cast("date"), "fecha_fin": F.lit(None).cast("date")})
    labels = e.where("slug IS NOT NULL").agg(F.collect_set("slug").alias("_all"))  # the labels of a data set are few
    asked = e.where("vec_id % 20 = 0").crossJoin(F.broadcast(labels)).select(F.col("vec_id").alias("pregunta"), F.col("embedding").alias("v"), F.array_except("_all", F.array("slug")).alias("slugs"), F.lit(None).cast("array<string>").alias("tipos"), F.lit(None).cast("date").alias("desde"), F.lit(None).cast("date").alias("hasta"))
    return retrieval.nearest(e, asked, "vec_id", "embedding", "pregunta", "v", filtered=True)


_WORDS = "list_filter(string_split_regex(lower(strip_accents({0})), '[^a-z0-9]+'), lambda w: w <> '')"


@query(
    "r09_named_products",
    f"""WITH {_ASKED}, a AS (SELECT DISTINCT pregunta, unnest({_WORDS.format('texto')}) AS w FROM q), t AS (SELECT id, list_filter({_WORDS.format('nombre_canonico')}, lambda w: length(w) > 2 AND NOT list_contains({_sql_list(STOP)}, w)) AS l FROM productos),
 n AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM t), k AS (SELECT w, count(DISTINCT id) AS c FROM n GROUP BY w), f AS (SELECT pregunta, id, count(*) AS n, bool_or(i = 1) AS cabeza, min(c) AS c FROM a JOIN n USING (w) JOIN k USING (w) GROUP BY ALL),
 s AS (SELECT pregunta, id, CASE WHEN n >= 2 THEN n + 2 WHEN cabeza THEN 2 WHEN c = 1 THEN 1 ELSE 0 END AS t FROM f) SELECT pregunta, id FROM s WHERE t > 0 QUALIFY t = max(t) OVER (PARTITION BY pregunta)""",
)
def _(spark, d):
    """The products that the questions of the query set name."""
    from lonja.functions.questions import mentions

    return mentions(_asked(table(spark, d, "documents")), table(spark, d, "productos"), "pregunta", "texto", "id", "nombre_canonico")


@query(
    "r12_days_in_range",
    "SELECT mercado, doc_id FROM documents WHERE tipo = 'mercado_dia' AND (fecha_fin IS NULL OR fecha_fin >= DATE '2024-05-01') AND (fecha_inicio IS NULL OR fecha_inicio <= DATE '2024-07-31') QUALIFY row_number() OVER (PARTITION BY mercado ORDER BY fecha_fin DESC NULLS LAST, doc_id) <= 3",
)
def _(spark, d):
    """The three latest market days within the dates of a question."""
    docs = table(spark, d, "documents").where("tipo = 'mercado_dia'").withColumns({"desde": F.lit("2024-05-01").cast("date"), "hasta": F.lit("2024-07-31").cast("date")}).where(retrieval.dated())
    rank = F.row_number().over(Window.partitionBy("mercado").orderBy(F.desc_nulls_last("fecha_fin"), "doc_id"))
    return docs.withColumn("k", rank).where("k <= 3").select("mercado", "doc_id")


@query(
    "a17_by_label",
    f"""WITH {_KNN}, g AS (SELECT q.vec_id AS pregunta, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0), h AS (SELECT pregunta, count(*) AS h, min(rango) AS r FROM n JOIN g USING (pregunta, vec_id) GROUP BY ALL), t AS (SELECT pregunta, count(*) AS n FROM g GROUP BY ALL)
 SELECT label, count(*) AS casos, count(*) FILTER (coalesce(h, 0) = n) AS completos, sum(coalesce(h, 0))::BIGINT AS aciertos, sum(CAST(floor(coalesce(1.0::DOUBLE / r, 0) * 1e6 + 0.5) AS BIGINT))::BIGINT AS mrr, count(*) FILTER (h IS NULL) AS fallos FROM t JOIN embeddings ON vec_id = pregunta LEFT JOIN h USING (pregunta) GROUP BY label""",
)
def _(spark, d):
    """The search judged by label: complete cases, hits, sum of reciprocal ranks in millionths, and cases with none."""
    from lonja.plans.reference import _nearest

    e = table(spark, d, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("pregunta"), "label")
    near = _nearest(spark, d).join(asked, "pregunta").join(e.withColumnRenamed("label", "_of"), "vec_id").where("label = _of")
    got = near.groupBy("pregunta").agg(F.count("*").alias("h"), F.min("rango").alias("r"))
    size = e.groupBy("label").agg(F.count("*").alias("n"))
    rows = asked.join(size, "label").join(got, "pregunta", "left")
    first = F.floor(F.coalesce(1 / F.col("r"), F.lit(0.0)) * 1e6 + 0.5).cast("bigint")
    return rows.groupBy("label").agg(F.count("*").alias("casos"), F.count_if(F.coalesce("h", F.lit(0)) == F.col("n")).alias("completos"), F.sum(F.coalesce("h", F.lit(0))).alias("aciertos"), F.sum(first).alias("mrr"), F.count_if(F.col("h").isNull()).alias("fallos"))


# -- SQL of queries that stand elsewhere ---------------------------------------------------------

SQL["r09_mentions"] = SQL["r09_named_products"]
SQL["w06_anomalies"] = f"WITH {PX}, {_BOTH} SELECT producto_id, mercado_id, tipo, fecha, valor, z FROM a WHERE abs(z) >= 3.5"
SQL["w08_featured_anomalies"] = f"""WITH {PX}, {_BOTH}, k AS (SELECT producto_id, mercado_id, tipo, fecha, valor, z, row_number() OVER (PARTITION BY producto_id, mercado_id, tipo ORDER BY floor(abs(z) * 1e6 + 0.5) DESC, fecha) AS rango FROM a WHERE abs(z) >= 3.5)
 SELECT k.* FROM k JOIN (SELECT mercado_id, max(fecha) AS f FROM px GROUP BY mercado_id) x ON x.mercado_id = k.mercado_id WHERE rango <= 5 OR fecha = f"""
