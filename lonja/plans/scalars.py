"""Queries of the scalar functions: formats, figures, dates, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import formats, questions
from lonja.functions import vectors as vec
from lonja.functions.calendar import MONTHS, WEEKDAYS, period
from lonja.functions.text import normalised
from lonja.operators import windows
from lonja.plans.general import KEY
from lonja.plans.reference import _RETURNS, PX, _sql_list, px, returns
from lonja.plans.registry import registry
from lonja.session import table

QUERIES, SQL, query = registry()

# -- formats ------------------------------------------------------------------------------------

_PERCENT = "concat(CASE WHEN v > 0 THEN '+' WHEN v < 0 AND (abs(v) + 500) // 1000 > 0 THEN '-' ELSE '' END, (abs(v) + 500) // 10000, '.', (abs(v) + 500) // 1000 % 10, '%')"
_SOLES = "concat('S/ ', (p + 50) // 10000, '.', printf('%02d', (p + 50) // 100 % 100))"
_TONNES = "CASE WHEN (m + 50) // 100 >= 1000 THEN concat((m + 50) // 100000, ' ', printf('%03d', (m + 50) // 100 % 1000)) ELSE CAST((m + 50) // 100 AS VARCHAR) END"


@query(
    "f09_formats",
    f"""WITH {PX}, {_RETURNS} SELECT px.producto_id, px.mercado_id, px.fecha, CASE WHEN p IS NULL THEN 'S/ —' ELSE {_SOLES} END AS precio, CASE WHEN v IS NULL THEN '—' ELSE {_PERCENT} END AS cambio,
 concat(CASE WHEN m IS NULL THEN '—' ELSE {_TONNES} END, ' t') AS masa, concat(CASE WHEN m IS NULL THEN '—' ELSE CAST((m + 50) // 100 AS VARCHAR) END, ' t') AS masa_junta FROM px LEFT JOIN r USING (producto_id, mercado_id, fecha)""",
)
def _(spark, d):
    rows = px(spark, d).withColumn("v", F.floor(windows.change("p") * 1e6 + 0.5))
    mass = F.col("m") / 100
    return rows.select(*KEY, formats.soles(F.col("p") / 10_000).alias("precio"), formats.percent(F.when(F.col("p").isNotNull(), F.col("v")) / 10_000).alias("cambio"), formats.tonnes(mass).alias("masa"), formats.tonnes(mass, spaced=False).alias("masa_junta"))


@query("f07_rounded", f"WITH {PX} SELECT producto_id, mercado_id, fecha, CAST((p + 50) // 100 AS DOUBLE) / 100 AS dos, CAST((p + 5000) // 10000 AS DOUBLE) AS ninguno FROM px")
def _(spark, d):
    price = F.col("p") / 10_000
    return px(spark, d).select(*KEY, formats.rounded(price, 2).alias("dos"), formats.rounded(price, 0).alias("ninguno"))


@query("f08_plain_types", f"WITH {PX} SELECT strftime(fecha, '%Y-%m-%d') AS fecha, CAST(sum(p) AS DOUBLE) / 10000 AS suma FROM px WHERE p IS NOT NULL GROUP BY fecha")
def _(spark, d):
    """Dates as ISO text, exact decimals as doubles."""
    total = F.sum((F.col("p").cast("decimal(20,0)") / 10_000).cast("decimal(20,4)"))
    return px(spark, d).where("p IS NOT NULL").groupBy("fecha").agg(total.alias("t")).select(F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), F.col("t").cast("double").alias("suma"))


@query("f03_match_keys", r"SELECT DISTINCT producto, trim(regexp_replace(upper(strip_accents(producto)), '\s+', ' ', 'g')) AS clave FROM documents WHERE producto IS NOT NULL UNION SELECT DISTINCT nombre_canonico, trim(regexp_replace(upper(strip_accents(nombre_canonico)), '\s+', ' ', 'g')) FROM productos WHERE nombre_canonico IS NOT NULL")
def _(spark, d):
    names = table(spark, d, "documents").select("producto").union(table(spark, d, "productos").select("nombre_canonico")).where("producto IS NOT NULL").distinct()
    return names.select("producto", formats.match_key("producto").alias("clave"))


@query(
    "c06_titled_names",
    r"SELECT id, list_aggregate(list_transform(regexp_extract_all(lower(concat(nombre_canonico, ' (', categoria, ')/selva')), '\p{L}+|[^\p{L}]+'), lambda s: concat(upper(s[1]), s[2:])), 'string_agg', '') AS titulo FROM productos",
)
def _(spark, d):
    return table(spark, d, "productos").select("id", formats.titled(F.concat("nombre_canonico", F.lit(" ("), F.coalesce("categoria", F.lit("")), F.lit(")/selva"))).alias("titulo"))


@query(
    "c05_figures",
    r"""WITH t AS (SELECT DISTINCT unnest(string_split(unidad, ' ')) AS t FROM precios_diarios UNION SELECT unnest(['1,862.5', '3,50', '-2', 'x', '12.', '.', '', '1.234,5']))
 SELECT t, TRY_CAST(regexp_replace(replace(t, ',', ''), '[^0-9.]', '', 'g') AS DOUBLE) AS informe, CASE WHEN regexp_matches(trim(t), '^-?[0-9]+([.,][0-9]+)?$') THEN TRY_CAST(replace(trim(t), ',', '.') AS DOUBLE) END AS otras FROM t WHERE t IS NOT NULL""",
)
def _(spark, d):
    """The words of units, and some figures, read in the report's way and in the other sources' way."""
    some = spark.range(1).select(F.explode(F.array(*map(F.lit, ("1,862.5", "3,50", "-2", "x", "12.", ".", "", "1.234,5")))).alias("t"))
    words = table(spark, d, "precios_diarios").select("unidad").distinct().select(F.explode(F.split("unidad", " ")).alias("t"))
    return words.unionByName(some).distinct().select("t", formats.report_number("t").alias("informe"), formats.plain_number("t").alias("otras"))


@query("f10_short_dates", f"SELECT fecha, concat(day(fecha), ' de ', {_sql_list(MONTHS)}[month(fecha)]) AS corta FROM (SELECT DISTINCT fecha FROM precios_diarios)")
def _(spark, d):
    return table(spark, d, "precios_diarios").select("fecha").distinct().select("fecha", formats.short_date("fecha").alias("corta"))


_LONG = f"concat({_sql_list(WEEKDAYS)}[isodow({{0}})], ' ', day({{0}}), ' de ', {_sql_list(MONTHS)}[month({{0}})], ' de ', year({{0}}))"
_SHORT = f"concat(day({{0}}), ' de ', {_sql_list(MONTHS)}[month({{0}})])"


@query(
    "f12_period_labels",
    f"""WITH f AS (SELECT DISTINCT fecha FROM precios_diarios WHERE fecha IS NOT NULL), g AS (SELECT 'dia' AS grano, strftime(fecha, '%Y-%m-%d') AS periodo, fecha FROM f UNION ALL SELECT 'semana', printf('%d-W%02d', isoyear(fecha), week(fecha)), fecha FROM f UNION ALL SELECT 'mes', strftime(fecha, '%Y-%m'), fecha FROM f),
 p AS (SELECT grano, periodo, min(fecha) AS a, max(fecha) AS z FROM g GROUP BY ALL)
 SELECT grano, periodo, CASE grano WHEN 'dia' THEN {_LONG.format("a")} WHEN 'mes' THEN concat({_sql_list(MONTHS)}[month(a)], ' de ', year(a)) ELSE concat('semana ', periodo, ' (', CASE WHEN a = z THEN {_SHORT.format("a")} ELSE concat('del ', {_SHORT.format("a")}, ' al ', {_SHORT.format("z")}) END, ')') END AS etiqueta FROM p""",
)
def _(spark, d):
    days = table(spark, d, "precios_diarios").where("fecha IS NOT NULL").select("fecha").distinct()
    parts = []
    for grain in ("dia", "semana", "mes"):
        held = days.groupBy(period("fecha", grain).alias("periodo")).agg(F.min("fecha").alias("a"), F.max("fecha").alias("z"))
        parts.append(held.select(F.lit(grain).alias("grano"), "periodo", formats.period_label("periodo", grain, "a", "z").alias("etiqueta")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- checks and classes -------------------------------------------------------------------------

#: An answer, the statement in it, and whether that may be run.
ANSWERS = (
    ("```sql\nSELECT * FROM px;\n```", "SELECT * FROM px", True),
    ("SQL: with a as (select 1) select * from a ;", "with a as (select 1) select * from a", True),
    ("Claro: SELECT 1; DROP TABLE px", "SELECT 1; DROP TABLE px", False),
    ("DELETE FROM px", "DELETE FROM px", False),
    ("SELECT 1 -- nada", "SELECT 1 -- nada", False),
    ("select '/*'", "select '/*'", False),
    ("with x as (select 1) insert into px select * from x", "with x as (select 1) insert into px select * from x", False),
    ("", "", False),
)


def _rows(*columns: str) -> str:
    quoted = lambda x: str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in ANSWERS) + f") t({', '.join(columns)})"


@query("f27_statements", f"SELECT respuesta, sentencia, segura FROM {_rows('respuesta', 'sentencia', 'segura')}")
def _(spark, d):
    """The statement in each answer, and whether it only reads."""
    rows = spark.createDataFrame([(a,) for a, _, _ in ANSWERS], "respuesta string").withColumn("sentencia", formats.bare_statement("respuesta"))
    return rows.select("respuesta", "sentencia", questions.read_only("sentencia").alias("segura"))


@query("f29_stated_prices", r"SELECT doc_id, regexp_matches(text, '(?i)S/\s*\d|\d+(?:[.,]\d+)?\s*soles') AS precio FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", formats.states_a_price("text").alias("precio"))


@query(
    "f24_kinds_asked",
    """WITH q AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(t, 'anomal|raro|extrano|inusual|salto|atipic') THEN 'evento_anomalia producto_periodo' WHEN regexp_matches(t, 'suele|normalmente|historic|estacional|tipico|promedio anual') THEN 'producto_perfil producto_periodo' END AS tipos,
 regexp_matches(t, 'suele|solia|normalmente|habitual|historic|estacional|tipic|en promedio|promedio historic|todos los anos|cada ano') AS estacional FROM q""",
)
def _(spark, d):
    """What each text, read as a question, narrows the search to."""
    kinds = F.array_join(questions.kinds_asked("text"), " ")
    return table(spark, d, "documents").select("doc_id", kinds.alias("tipos"), normalised("text").rlike(questions.SEASONAL).alias("estacional"))


@query("f35_directions", f"WITH {PX}, {_RETURNS} SELECT producto_id, mercado_id, fecha, CASE WHEN v > 0 THEN 'sube' WHEN v < 0 THEN 'baja' ELSE 'igual' END AS sentido FROM r")
def _(spark, d):
    return returns(spark, d).select(*KEY, formats.direction("v").alias("sentido"))


@query("f36_clamped", "SELECT DISTINCT reporte_id, CASE WHEN n_filas IS NOT NULL THEN greatest(1, least(n_filas, 10)) END AS n FROM reportes")
def _(spark, d):
    return table(spark, d, "reportes").select("reporte_id", formats.clamped("n_filas", 10).alias("n")).distinct()


@query(
    "f33_freshness",
    """WITH m AS (SELECT mercado_id, max(fecha) AS f, max(cargado_en) AS c FROM precios_diarios WHERE mercado_id IS NOT NULL GROUP BY mercado_id)
 SELECT mercado_id, f AS ultima, CAST(floor(date_diff('second', CAST(f + 1 AS TIMESTAMP), c) / 3600.0) AS BIGINT) AS horas, CAST(floor(date_diff('second', CAST(f + 1 AS TIMESTAMP), c) / 3600.0) AS BIGINT) > 48 AS atrasado FROM m""",
)
def _(spark, d):
    """How long after the end of its last day each market was last loaded; over two days is late."""
    last = table(spark, d, "precios_diarios").where("mercado_id IS NOT NULL").groupBy("mercado_id").agg(F.max("fecha").alias("ultima"), F.max(F.col("cargado_en").cast("timestamp_ntz")).alias("c"))
    hours = formats.stale_hours("ultima", "c")
    return last.select("mercado_id", "ultima", hours.alias("horas"), (hours > 48).alias("atrasado"))


@query("f34_signatures", "SELECT * FROM (VALUES ('hash:bag-64:64', 'hash_bag-64_64'), ('api:modelo/grande v2:256', 'api_modelo_grande_v2_256')) t(firma, carpeta)")
def _(spark, d):
    made = [("hash:bag-64:64", formats.signature_file("hash", "bag-64", 64)), ("api:modelo/grande v2:256", formats.signature_file("api", "modelo/grande v2", 256))]
    return spark.createDataFrame(made, "firma string, carpeta string")


@query(
    "f06_telling_words",
    f"SELECT id, array_to_string(list_filter(string_split_regex(lower(strip_accents(nombre_canonico)), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_sql_list(questions.STOP)}, w)), ' ') AS palabras FROM productos",
)
def _(spark, d):
    return table(spark, d, "productos").select("id", F.array_join(questions.telling("nombre_canonico"), " ").alias("palabras"))


# -- vectors ------------------------------------------------------------------------------------

_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(
    "f22_cosines",
    f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), p AS (SELECT a.vec_id, list_inner_product(a.v, b.v) AS d, sqrt(list_inner_product(a.v, a.v)) AS n, sqrt(list_inner_product(b.v, b.v)) AS o FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, floor(d * 1e6 + 0.5) AS producto, floor(d / (n * o) * 1e6 + 0.5) AS coseno FROM p""",
)
def _(spark, d):
    """Inner product and cosine of each vector with the next one; the cosine by lengths of 1 and their distance."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"), vec.normalised("embedding").alias("u"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"), F.col("u").alias("w"))
    pair = e.join(other, "vec_id")
    return pair.select("vec_id", F.floor(vec.dot("a", "b") * 1e6 + 0.5).cast("double").alias("producto"), F.floor(vec.cosine_of_distance(vec.distance("u", "w")) * 1e6 + 0.5).cast("double").alias("coseno"))


@query("f19_corpus_hash", "SELECT tipo, CAST(sum(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT)) AS VARCHAR) AS huella, count(*) AS textos FROM documents WHERE doc_id IS NOT NULL GROUP BY tipo")
def _(spark, d):
    """A fingerprint of each kind's ids and texts, by which a stale index is told: the sum of their hashes, so no order is needed."""
    hashed = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.coalesce("text", F.lit(""))), 256)
    number = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("decimal(20,0)")
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL").groupBy("tipo")
    return rows.agg(F.sum(number).cast("string").alias("huella"), F.count("*").alias("textos"))
