"""Pages of reports, laid out as words from the tables and read again: rows, bands, names, trends, layouts.

There is no PDF here, so the words of a page are made by a plan: each line's texts at the places where a
report prints them. The SQL counterparts know nothing of places; they state what must come out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions import formats
from lonja.operators import layout
from lonja.plans.reference import PX, px
from lonja.plans.registry import registry
from lonja.session import table
from lonja.sources import store

QUERIES, SQL, query = registry()

ROW = ["reporte_id", "linea"]
#: Places of the report: where names end and masses begin and end, and the bands of the four masses.
EDGES = (200.0, 205.0, 365.0)
MASSES = {"masa_ayer": (205.0, 245.0), "masa_hoy": (245.0, 285.0), "masa_7d": (285.0, 325.0), "masa_4lun": (325.0, 365.0)}
#: The trends that a report prints, and how they read without blanks and marks.
TRENDS = {"estable": "Estable", "enalza": "En Alza", "enbaja": "En Baja", "alzanotable": "Alza Notable", "bajanotable": "Baja Notable"}


def _printed(c: str, scale: int) -> Column:
    """A figure as the report prints it, with commas between thousands; ":" for a missing one."""
    v = F.floor(F.nanvl(F.col(c), F.lit(None)) * scale + 0.5).cast("bigint")
    whole = F.regexp_replace(F.floor(v / scale).cast("bigint").cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")
    places = len(str(scale)) - 1
    return F.when(v >= 0, F.concat(whole, F.lit("."), F.lpad((v % scale).cast("string"), places, "0"))).otherwise(":")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a report once (the least of repeated ones), its name in letters and blanks only."""
    rows = table(spark, d, "filas_reporte").where("reporte_id IS NOT NULL AND linea IS NOT NULL")
    name = F.trim(F.regexp_replace(F.regexp_replace("producto", r"[^\p{L} ]", " "), r" +", " "))
    values = ["masa_ayer", "masa_hoy", "masa_7d", "masa_4lun", "equiv_kg", "precio_ayer_unit", "precio_hoy_unit", "precio_7d_unit", "tendencia"]
    held = rows.groupBy(*ROW).agg(F.min_by(F.struct(name.alias("nombre"), F.regexp_replace("unidad", r"[^\p{L} ]", "").alias("unidad"), *values), "fila_id").alias("_r"))
    return held.select(*ROW, "_r.*").where("nombre <> ''")


_LINES = r"""l AS (SELECT reporte_id, linea, arg_min({'nombre': trim(regexp_replace(regexp_replace(producto, '[^\p{L} ]', ' ', 'g'), ' +', ' ', 'g')), 'u': nullif(trim(regexp_replace(regexp_replace(unidad, '[^\p{L} ]', '', 'g'), ' +', ' ', 'g')), ''),
  'a': masa_ayer, 'h': masa_hoy, 's': masa_7d, 'c': masa_4lun, 'e': equiv_kg, 'y': precio_ayer_unit, 'p': precio_hoy_unit, 'm': precio_7d_unit, 't': tendencia}, fila_id) AS r FROM filas_reporte WHERE reporte_id IS NOT NULL AND linea IS NOT NULL GROUP BY ALL)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """reporte_id, x0, x1, top, texto: the words of every report's page, and its head."""
    unit = F.filter(F.split(F.coalesce("unidad", F.lit("")), " +"), lambda t: t != "")
    trend = F.regexp_replace(F.coalesce("tendencia", F.lit("")), r"[^\p{L}]", "")
    mean = F.concat(F.regexp_replace(_printed("precio_7d_unit", 100), ":", ""), trend)
    cells = [(215.0, "masa_ayer"), (255.0, "masa_hoy"), (295.0, "masa_7d"), (335.0, "masa_4lun")]
    word = lambda x, t, wide=8.0: F.struct(x.alias("x0"), (x + wide).alias("x1"), t.alias("texto"))
    name = F.transform(F.split("nombre", " "), lambda t, i: word(F.lit(20.0) + i * 9.0, t))
    units = F.transform(unit, lambda t, i: word(F.lit(370.0) + i * 9.0, t))
    figures = [*((x, _printed(c, 10)) for x, c in cells)]
    later = [(500.0, _printed("equiv_kg", 1000)), (520.0, _printed("precio_ayer_unit", 100)), (540.0, _printed("precio_hoy_unit", 100))]
    fixed = lambda xs: F.array(*[word(F.lit(x), t) for x, t in xs])
    last = F.when(mean != "", F.array(word(F.lit(560.0), mean, 30.0))).otherwise(F.array().cast("array<struct<x0:double,x1:double,texto:string>>"))
    every = F.concat(name, fixed(figures), units, fixed(later), last)
    # Words of one line stand a little apart in height, lines well apart.
    rows = _lines(spark, d).select("reporte_id", "linea", F.posexplode(every).alias("_i", "_w"))
    return rows.select("reporte_id", "_w.x0", "_w.x1", (F.lit(200.0) + F.col("linea") * 12.0 + F.pmod("_i", F.lit(3)) * 0.7).alias("top"), "_w.texto", "linea")


@query("c01_rows_of_words", f"WITH {_LINES} SELECT reporte_id, dense_rank() OVER (PARTITION BY reporte_id ORDER BY linea) - 1 AS renglon, linea FROM l WHERE r.nombre <> ''")
def _(spark, d):
    """The words of each page put together into rows again."""
    found = layout.clustered(words(spark, d), ["reporte_id"], "top", "x0")
    return found.groupBy("reporte_id", F.col("renglon").cast("bigint").alias("renglon")).agg(F.max("linea").alias("linea"))


_TENTHS = "CASE WHEN r.{0} >= 0 AND NOT isnan(r.{0}) THEN floor(r.{0} * {1} + 0.5) / {1} END"


@query(
    "c04_report_rows",
    f"""WITH {_LINES} SELECT reporte_id, linea, r.nombre AS nombre, {", ".join(f"{_TENTHS.format(k, 10)} AS {n}" for k, n in zip("ahsc", MASSES))}, FALSE AS ambiguo, r.u AS unidad, {_TENTHS.format("e", 1000)} AS equiv, {_TENTHS.format("y", 100)} AS ayer, {_TENTHS.format("p", 100)} AS hoy, {_TENTHS.format("m", 100)} AS media,
 CASE lower(regexp_replace(strip_accents(coalesce(r.t, '')), '[^a-zA-Z]', '', 'g')) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRENDS.items())} END AS tendencia FROM l WHERE r.nombre <> ''""",
)
def report_rows(spark, d):
    """Names, masses, units, prices and trends of each row of a page, by what its words are and where they stand."""
    found = layout.clustered(words(spark, d), ["reporte_id"], "top", "x0")
    rows = layout.report_rows(found, ["reporte_id", "renglon", "linea"], "x0", "x1", "texto", EDGES, MASSES, formats.report_number)
    known = F.create_map(*[F.lit(x) for kv in TRENDS.items() for x in kv])
    key = F.lower(F.regexp_replace(formats.match_key("letras"), "[^A-Z]", ""))
    return rows.select(*ROW, "nombre", *MASSES, "ambiguo", "unidad", "equiv", "ayer", "hoy", "media", F.try_element_at(known, key).alias("tendencia"))


@query(
    "c02_masses",
    """SELECT caso, CAST(masa_ayer AS DOUBLE) AS masa_ayer, CAST(masa_hoy AS DOUBLE) AS masa_hoy, CAST(masa_7d AS DOUBLE) AS masa_7d, CAST(masa_4lun AS DOUBLE) AS masa_4lun, ambiguo FROM (VALUES (1, 1.0, 2.0, NULL, 4.0, FALSE), (2, 5.0, NULL, NULL, 6.0, FALSE), (3, 5.0, NULL, NULL, NULL, TRUE), (4, 1.0, 2.0, 3.0, 4.0, TRUE), (5, NULL, NULL, NULL, NULL, FALSE), (6, 1.0, 2.0, 3.0, 4.0, FALSE)) t(caso, masa_ayer, masa_hoy, masa_7d, masa_4lun, ambiguo)""",
)
def _(spark, d):
    """Four cells by order, others by place; what does not fit is ambiguous."""
    cases = [(1, [(210.0, 1.0), (250.0, 2.0), (290.0, None), (330.0, 4.0)]), (2, [(210.0, 5.0), (340.0, 6.0)]), (3, [(210.0, 5.0), (230.0, 7.0)]), (4, [(210.0, 1.0), (250.0, 2.0), (290.0, 3.0), (330.0, 4.0), (340.0, 9.0)]), (5, []), (6, [(240.0, 1.0), (280.0, 2.0), (320.0, 3.0), (360.0, 4.0)])]
    rows = spark.createDataFrame(cases, "caso int, c array<struct<at:double,v:double>>")
    return rows.select("caso", layout.four_masses(F.col("c"), MASSES).alias("m")).select("caso", "m.*")


@query("c18_row_warnings", f"""WITH {_LINES} SELECT reporte_id, linea, array_to_string(list_filter([CASE WHEN r.u IS NULL THEN 'sin unidad' END, CASE WHEN v / e < 0.2 OR v / e > 60 THEN 'precio fuera de rango' END], lambda x: x IS NOT NULL), '; ') AS avisos
 FROM (SELECT *, {_TENTHS.format("p", 100)} AS v, nullif({_TENTHS.format("e", 1000)}, 0) AS e FROM l WHERE r.nombre <> '')""")
def _(spark, d):
    """What is odd about each row of a page; nothing of it holds the row back."""
    price = F.try_divide("hoy", "equiv")
    odd = F.array_compact(F.array(F.when(F.col("unidad").isNull(), "sin unidad"), F.when((price < 0.2) | (price > 60), "precio fuera de rango")))
    return report_rows(spark, d).select(*ROW, F.array_join(odd, "; ").alias("avisos"))


@query("c03_glued", "SELECT producto_id, mercado_id, fecha, CAST(p AS DOUBLE) / 10000 AS numero, regexp_replace(coalesce(tendencia, ''), '[^\\p{L}]', '', 'g') AS letras FROM (WITH " + PX + " SELECT * FROM px WHERE p IS NOT NULL)")
def _(spark, d):
    """A price and a trend that run into each other, told apart again."""
    rows = px(spark, d).where("p IS NOT NULL")
    glued = F.concat(F.floor(F.col("p") / 10_000).cast("string"), F.lit("."), F.lpad((F.col("p") % 10_000).cast("string"), 4, "0"), F.regexp_replace(F.coalesce("tendencia", F.lit("")), r"[^\p{L}]", ""))
    number, letters = layout.split_letters(glued)
    return rows.select("producto_id", "mercado_id", "fecha", number.alias("numero"), letters.alias("letras"))


HEAD = ("productos", "masa", "unidad", "precios", "equiv", "ultimos")


@query(
    "c09_layouts",
    """WITH r AS (SELECT DISTINCT reporte_id, fuente FROM reportes WHERE reporte_id IS NOT NULL)
 SELECT reporte_id, max(CASE WHEN contains(fuente, '3') THEN 'productos|unidad|masa|precios|equiv' ELSE 'productos|masa|unidad|precios|equiv|ultimos' END) AS huella, max(CASE WHEN contains(fuente, '3') THEN 'ultimos' ELSE '' END) AS faltan FROM r GROUP BY reporte_id""",
)
def _(spark, d):
    """The words of each page's head in their order, and those that are missing."""
    odd = F.contains("fuente", F.lit("3"))
    heads = F.when(odd, F.array(*map(F.lit, ("Productos", "UNIDAD", "masa", "Precios", "Equiv")))).otherwise(F.array(*[F.lit(h.title()) for h in HEAD]))
    rows = table(spark, d, "reportes").where("reporte_id IS NOT NULL").groupBy("reporte_id").agg(F.max(F.when(odd, F.col("fuente"))).alias("o"), F.max("fuente").alias("f"))
    rows = rows.select("reporte_id", F.coalesce("o", "f").alias("fuente"))
    placed = rows.select("reporte_id", F.posexplode(heads).alias("i", "texto")).withColumn("x0", F.col("i") * 40.0)
    found = layout.fingerprint(placed, ["reporte_id"], "texto", "x0", HEAD)
    return found.select("reporte_id", "huella", F.array_join("faltan", " ").alias("faltan"))


@query("c11_markets_in_text", f"WITH {PX} SELECT DISTINCT producto_id, mercado_id, concat('mercado ', lower(codigo)) AS mercado, nombre_canonico AS producto FROM px JOIN productos ON productos.id = producto_id JOIN mercados ON mercados.id = mercado_id")
def _(spark, d):
    """A market and a product in one text, told apart by the longest market that it begins with."""
    markets = table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), F.concat(F.lit("mercado "), F.lower("codigo")).alias("mercado"))
    pairs = px(spark, d).select("producto_id", "mercado_id").distinct().join(markets, "mercado_id").join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), "nombre_canonico"), "producto_id")
    rows = pairs.select("producto_id", "mercado_id", F.concat("mercado", F.lit(" "), "nombre_canonico").alias("t"))
    found = layout.longest_prefix(rows, "t", markets.unionByName(markets.select("mercado_id", F.lit("mercado").alias("mercado"))), "mercado")
    return found.select("producto_id", "mercado_id", F.col("prefijo").alias("mercado"), F.col("resto").alias("producto"))


#: Bands of the second source: its five figures.
FIVE = {"ayer": (300.0, 340.0), "hoy": (340.0, 380.0), "minimo": (380.0, 420.0), "maximo": (420.0, 460.0), "masa": (460.0, 500.0)}


@query(
    "s08_second_source",
    f"""WITH {PX}, l AS (SELECT *, lag(p) OVER k AS q, min(p) OVER (PARTITION BY producto_id, mercado_id) AS lo, max(p) OVER (PARTITION BY producto_id, mercado_id) AS hi FROM px WINDOW k AS (PARTITION BY producto_id, mercado_id ORDER BY fecha) QUALIFY row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) = 1)
 SELECT concat('mercado ', lower(codigo)) AS mercado, nombre_canonico AS producto, CAST(q AS DOUBLE) / 10000 AS ayer, CAST(p AS DOUBLE) / 10000 AS hoy, CAST(lo AS DOUBLE) / 10000 AS minimo, CAST(hi AS DOUBLE) / 10000 AS maximo, CAST(m AS DOUBLE) / 100 AS masa FROM l JOIN productos ON productos.id = producto_id JOIN mercados ON mercados.id = mercado_id WHERE p IS NOT NULL OR q IS NOT NULL""",
)
def _(spark, d):
    """Pages of the second source read: market and product in one text, figures by the band they stand in, rows with a price."""
    from pyspark.sql import Window

    own = Window.partitionBy("producto_id", "mercado_id")
    rows = px(spark, d).withColumns({"q": F.lag("p").over(own.orderBy("fecha")), "lo": F.min("p").over(own), "hi": F.max("p").over(own), "k": F.row_number().over(own.orderBy(F.desc("fecha")))}).where("k = 1")
    markets = table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), F.concat(F.lit("mercado "), F.lower("codigo")).alias("mercado"))
    rows = rows.join(markets, "mercado_id").join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), "nombre_canonico"), "producto_id")

    def printed(c: str, scale: int) -> Column:
        return F.when(F.col(c).isNull(), "s/d").otherwise(F.concat(F.floor(F.col(c) / scale).cast("string"), F.lit(","), F.lpad((F.col(c) % scale).cast("string"), len(str(scale)) - 1, "0")))

    figures = zip((310.0, 350.0, 390.0, 430.0, 470.0), ("q", "p", "lo", "hi", "m"), (10_000, 10_000, 10_000, 10_000, 100))
    cells = F.array(*[F.struct(F.lit(x).alias("x0"), printed(c, k).alias("texto")) for x, c, k in figures])
    text = F.concat("mercado", F.lit(" "), "nombre_canonico")
    laid = rows.select(F.struct("mercado_id", "producto_id").alias("renglon"), text.alias("t"), F.explode(cells).alias("w")).select("renglon", "t", "w.*")
    read = layout.numbers_in_bands(laid, ["renglon", "t"], "x0", "texto", FIVE, formats.plain_number).where("ayer IS NOT NULL OR hoy IS NOT NULL")
    found = layout.longest_prefix(read, "t", markets, "mercado")
    return found.select(F.col("prefijo").alias("mercado"), F.col("resto").alias("producto"), *FIVE)


@query("c13_words_of_glyphs", "SELECT id, upper(nombre_canonico) AS texto FROM productos WHERE nombre_canonico IS NOT NULL")
def _(spark, d):
    """Names printed letter by letter, put together again: a blank where letters stand apart."""
    rows = table(spark, d, "productos").where("nombre_canonico IS NOT NULL").select("id", F.upper("nombre_canonico").alias("n"))
    glyph = rows.select("id", F.posexplode(F.split("n", "")).alias("i", "texto"))
    return layout.joined(glyph.where("texto <> ' '").select("id", "texto", (F.col("i") * 5.0).alias("x0"), (F.col("i") * 5.0 + 5.0).alias("x1")), ["id"], "x0", "x1", "texto")


@query(
    "c14_bulletin_rows",
    f"""WITH {PX}, v AS (SELECT *, row_number() OVER (PARTITION BY producto_id, mercado_id ORDER BY fecha DESC) AS k FROM px)
 SELECT codigo AS mercado, printf('%05d', producto_id) AS cnpa, upper(nombre_canonico) AS producto, CAST(p AS DOUBLE) / 10000 AS precio FROM v JOIN productos ON productos.id = producto_id JOIN mercados ON mercados.id = mercado_id WHERE k = 1 AND p IS NOT NULL AND length(nombre_canonico) >= 2""",
)
def _(spark, d):
    """The grid of the bulletin, glyph by glyph: rows with a code of five digits, a known market and a price."""
    from lonja.operators import windows

    last = windows.latest(px(spark, d).select("producto_id", "mercado_id", "fecha", "p"))
    markets = table(spark, d, "mercados").select(F.col("id").alias("mercado_id"), "codigo")
    rows = last.join(markets, "mercado_id").join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), "nombre_canonico"), "producto_id")
    price = F.when(F.col("p").isNotNull(), F.concat(F.floor(F.col("p") / 10_000).cast("string"), F.lit(","), F.lpad((F.col("p") % 10_000).cast("string"), 4, "0"))).otherwise("-")
    place = lambda text, x: F.transform(F.split(text, ""), lambda t, i: F.struct((F.lit(x) + i * 2.0).alias("x0"), (F.lit(x) + i * 2.0 + 2.0).alias("x1"), t.alias("texto")))
    whole = lambda text, x: F.array(F.struct(F.lit(x).alias("x0"), F.lit(x + 8.0).alias("x1"), text.alias("texto")))
    glyphs = F.filter(F.concat(whole(F.format_string("%05d", "producto_id"), 10.0), place(F.col("codigo"), 40.0), place(F.upper("nombre_canonico"), 100.0), whole(price, 400.0)), lambda w: w["texto"] != " ")
    heads = spark.range(1).select(F.lit(None).cast("int").alias("mercado_id"), F.lit(None).cast("int").alias("producto_id"), whole(F.lit("HORTALIZAS"), 10.0).alias("w"))
    laid = rows.select("mercado_id", "producto_id", glyphs.alias("w")).unionByName(heads)
    laid = laid.withColumn("renglon", F.struct("mercado_id", "producto_id")).select("renglon", F.explode("w").alias("w")).select("renglon", "w.*")
    return layout.bulletin_rows(laid, ["renglon"], "x0", "x1", "texto", code=(0.0, 30.0), market=(35.0, 95.0), name=(95.0, 390.0), price=(390.0, 450.0), number=formats.plain_number, markets=markets.select(F.col("codigo").alias("mercado"))).select("mercado", "cnpa", "producto", "precio")


# -- navigation ---------------------------------------------------------------------------------


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """hoja, html: the index of a source's pages, some links a sheet, newest first, with links between the sheets.

    Sheets overlap by one link, as paginated indexes do while they grow, and the last one repeats the one before."""
    from pyspark.sql import Window

    months = table(spark, d, "reportes").where("fecha IS NOT NULL").select(F.date_format("fecha", "yyyy-MM").alias("m")).distinct()
    placed = months.withColumn("i", F.row_number().over(Window.orderBy(F.desc("m"))) - 1)  # months of a calendar: some hundred rows
    sheets = placed.select(F.explode(F.array_distinct(F.array(F.floor(F.col("i") / 4).cast("int"), F.floor((F.col("i") + 1) / 4).cast("int")))).alias("hoja"), "i", "m")
    pages = sheets.groupBy("hoja").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("w"))
    html = F.concat(F.lit("<a href='/coleccion?hoja=2'>2</a>"), F.array_join(F.transform("w", lambda x: F.concat(F.lit("<a href='/mes/"), x["m"], F.lit("'>"), x["m"], F.lit("</a>"))), ""))
    last = pages.agg(F.max_by("w", "hoja").alias("w"), F.max("hoja").alias("h"))
    # After the last sheet the site shows it again, and then what is no longer listed.
    again = last.select((F.col("h") + 1).alias("hoja"), "w").where("w IS NOT NULL")
    old = last.where("h IS NOT NULL").select((F.col("h") + 2).alias("hoja"), F.array(F.struct(F.lit(0).alias("i"), F.lit("1999-01").alias("m"))).alias("w"))
    return pages.unionByName(again).unionByName(old).select("hoja", html.alias("html"))


@query("s01_month_pages", "SELECT DISTINCT concat('/mes/', strftime(fecha, '%Y-%m')) AS enlace, dense_rank() OVER (ORDER BY strftime(fecha, '%Y-%m') DESC) AS lugar FROM reportes WHERE fecha IS NOT NULL")
def _(spark, d):
    """The month pages of a collection, at their first place, up to the first sheet with nothing new."""
    return store.month_pages(_sheets(spark, d), store.COLLECTIONS["mayorista"])


@query("s02_latest_month", "SELECT concat('/mes/', strftime(max(fecha), '%Y-%m')) AS enlace FROM reportes HAVING max(fecha) IS NOT NULL")
def _(spark, d):
    return store.month_pages(_sheets(spark, d), store.COLLECTIONS["mayorista"], most=1).select("enlace")


@query("s04_latest_dailies", "SELECT * FROM (SELECT fuente, fecha, min(url) AS url FROM fuentes_raw WHERE fecha IS NOT NULL AND url IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fuente ORDER BY fecha DESC) <= 5")
def _(spark, d):
    """The last five days of each source that have a link."""
    days = table(spark, d, "fuentes_raw").where("fecha IS NOT NULL AND url IS NOT NULL").groupBy("fuente", "fecha").agg(F.min("url").alias("url"))
    return store.last_of_each(days, ["fuente"], "fecha", 5)
