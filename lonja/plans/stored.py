"""Queries that write to tables on shared storage and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lonja.operators import index, windows
from lonja.operators.series import SERIES
from lonja.plans.general import KEY
from lonja.plans.reference import MASS, PX, SOLES, W, px, ticks
from lonja.plans.registry import registry
from lonja.session import shared_folder, table
from lonja.sources import store
from lonja.streaming import prices

QUERIES, SQL, query = registry()


def _place(spark: SparkSession, name: str) -> str:
    """A new table of this session in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s12_tables", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(t, *f.split(" ")) for t, s in store.SCHEMAS.items() for f in s.split(", ")) + ") t(tabla, columna, tipo)")
def _(spark, d):
    """The tables of the store, made where they are absent, with their columns."""
    base = _place(spark, "store")
    for _ in range(2):  # the second time there is nothing to do
        store.create(spark, base)
    rows = [(t, f.name, f.dataType.simpleString()) for t in store.SCHEMAS for f in spark.read.parquet(f"{base}/{t}").schema]
    return spark.createDataFrame(rows, "tabla string, columna string, tipo string")


@query(
    "s13_market_ids",
    """WITH n AS (SELECT DISTINCT codigo FROM (SELECT fuente AS codigo FROM fuentes_raw UNION ALL SELECT mercado FROM documents) WHERE codigo IS NOT NULL AND codigo NOT IN (SELECT codigo FROM mercados WHERE codigo IS NOT NULL))
 SELECT codigo, id FROM mercados WHERE codigo IS NOT NULL AND id IS NOT NULL UNION ALL SELECT codigo, CAST((SELECT coalesce(max(id), 0) FROM mercados WHERE codigo IS NOT NULL) + row_number() OVER (ORDER BY codigo) AS INTEGER) FROM n""",
)
def _(spark, d):
    """An id for every market that texts and sources name: known ones keep theirs, new ones follow the greatest."""
    known = table(spark, d, "mercados").where("codigo IS NOT NULL AND id IS NOT NULL").select("codigo", "id")
    named = table(spark, d, "fuentes_raw").select(F.col("fuente").alias("codigo")).union(table(spark, d, "documents").select("mercado"))
    return store.with_ids(known, named, "codigo", "id")


@query("s14_products", "WITH t AS (SELECT producto AS nombre, unidad, equiv_kg, fila_id FROM filas_reporte WHERE producto IS NOT NULL) SELECT nombre, unidad, CASE WHEN isnan(equiv_kg) THEN NULL ELSE equiv_kg END AS equiv_kg FROM t QUALIFY row_number() OVER (PARTITION BY nombre ORDER BY fila_id DESC) = 1")
def _(spark, d):
    """The units of each product as last delivered, upserted in two runs that come in the wrong order."""
    rows = table(spark, d, "filas_reporte").where("producto IS NOT NULL").select(F.col("producto").alias("nombre"), "unidad", F.nanvl("equiv_kg", F.lit(None)).alias("equiv_kg"), "fila_id", F.lit(None).cast("date").alias("alta"))
    path = _place(spark, "products")
    middle = rows.agg(F.avg("fila_id")).first()[0] or 0
    for part in (rows.where(F.col("fila_id") >= middle), rows.where(F.col("fila_id") < middle)):
        store.upsert(spark, path, part, ["nombre"], "fila_id", "alta")
    return store.read(spark, path, rows.schema).select("nombre", "unidad", "equiv_kg")


@query("s15_first_kept", "SELECT producto AS nombre, CASE WHEN producto IN (SELECT nombre_canonico FROM productos WHERE nombre_canonico IS NOT NULL) THEN 'conocido' ELSE 'nuevo' END AS estado FROM (SELECT DISTINCT producto FROM filas_reporte WHERE producto IS NOT NULL) UNION SELECT nombre_canonico, 'conocido' FROM productos WHERE nombre_canonico IS NOT NULL")
def _(spark, d):
    """Names inserted where they are absent; what is known of a present one is not touched."""
    known = table(spark, d, "productos").where("nombre_canonico IS NOT NULL").select(F.col("nombre_canonico").alias("nombre"), F.lit("conocido").alias("estado")).distinct()
    named = table(spark, d, "filas_reporte").where("producto IS NOT NULL").select(F.col("producto").alias("nombre"), F.lit("nuevo").alias("estado"))
    return known.unionByName(store.insert_new(known, named, ["nombre"]))


def _loads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "precios_diarios").where("producto_id IS NOT NULL AND mercado_id IS NOT NULL AND fecha IS NOT NULL")
    return rows.select(*KEY, ticks("precio_hoy_kg", 1e4, SOLES).alias("p"), ticks("masa_hoy", 100, MASS).alias("m"), "tendencia", F.col("cargado_en").cast("timestamp").alias("cargado_en"))


@query("s16_stored_prices", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p, m FROM px")
def _(spark, d):
    """All loads of prices upserted, late ones before the others and some of them twice; the latest load of each key holds."""
    rows, path = _loads(spark, d), _place(spark, "prices")
    late = F.coalesce(F.datediff(F.to_date("cargado_en"), "fecha") > 7, F.lit(False))
    for part in (rows.where(late), rows.where(~late), rows.where(late)):
        store.upsert(spark, path, part, KEY, "cargado_en", "fecha")
    return store.read(spark, path, rows.schema).select(*KEY, "p", "m")


@query("s17_stored_forecasts", f"WITH {PX}, u AS (SELECT *, row_number() OVER ({W} DESC) AS k, lag(p, 4) OVER ({W}) AS e FROM px WHERE p IS NOT NULL) SELECT producto_id, mercado_id, fecha, h AS horizonte, e * h AS bajo, e * h + 100 AS alto FROM u, (VALUES (1), (7)) t(h) WHERE k <= 3 AND e IS NOT NULL")
def _(spark, d):
    """Forecasts upserted by product, market, day and horizon (1 where none is given), their interval in two columns; a second run replaces them."""
    from pyspark.sql import Window

    own = Window.partitionBy(*SERIES)
    rows = px(spark, d).where("p IS NOT NULL").withColumns({"k": F.row_number().over(own.orderBy(F.desc("fecha"))), "e": F.lag("p", 4).over(own.orderBy("fecha"))}).where("k <= 3 AND e IS NOT NULL")
    path = _place(spark, "forecasts")
    for run in (1, 2):
        made = rows.select(*KEY, F.explode(F.array(F.lit(None).cast("int"), F.lit(7))).alias("horizonte"), F.col("e"), F.lit(run).alias("corrida"))
        shift = 100 if run == 2 else 50
        made = made.withColumn("intervalo", F.array(F.col("e") * F.coalesce("horizonte", F.lit(1)), F.col("e") * F.coalesce("horizonte", F.lit(1)) + shift))
        store.upsert_forecasts(spark, path, made, "corrida")
    return store.read(spark, path, StructType([*made.select(*KEY, "horizonte").schema, *StructType.fromDDL("bajo bigint, alto bigint")])).select(*KEY, "horizonte", "bajo", "alto")


@query(
    "s18_dated_later",
    "SELECT id, fuente, coalesce(fecha, CASE WHEN bytes > 300000 THEN CAST(descargado_en AS DATE) END) AS fecha FROM fuentes_raw WHERE id IS NOT NULL",
)
def _(spark, d):
    """Sources upserted with the date that is known, some again when their date is: they move to its month, the others stay without."""
    rows = table(spark, d, "fuentes_raw").where("id IS NOT NULL").select("id", "fuente", "fecha", "bytes", F.col("descargado_en").cast("date").alias("_f"))
    path = _place(spark, "sources")
    store.upsert(spark, path, rows.select("id", "fuente", "fecha", F.lit(1).alias("vez")), ["id"], "vez", "fecha")
    dated = rows.where("fecha IS NULL AND bytes > 300000").select("id", "fuente", F.col("_f").alias("fecha"), F.lit(2).alias("vez"))
    for _ in range(2):
        store.upsert(spark, path, dated, ["id"], "vez", "fecha")
    return store.read(spark, path, rows.select("id", "fuente", "fecha").schema)


@query("t02_streamed_prices", f"WITH {PX} SELECT producto_id, mercado_id, fecha, p, m FROM px")
def _(spark, d):
    """The loads of prices as a stream that is upserted as far as it goes, and started again with nothing new."""
    inbox, path, kept = (_place(spark, n) for n in ("inbox", "streamed", "progress"))
    rows = _loads(spark, d)
    rows.write.parquet(inbox)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        prices.upserted(stream, path, kept, KEY, "cargado_en", "fecha").awaitTermination()
    return store.read(spark, path, rows.schema).select(*KEY, "p", "m")


@query("s26_kept_results", f"WITH {PX} SELECT producto_id, mercado_id, count(p) AS n, TRUE AS reusado FROM px GROUP BY ALL")
def _(spark, d):
    """A result computed once for a version of the data, and found again; a broken one is computed anew."""
    base = _place(spark, "results")
    make = lambda: px(spark, d).groupBy(*SERIES).agg(F.count("p").alias("n"))
    version = store.version_of(table(spark, d, "precios_diarios"), ["producto_id", "mercado_id", "fecha", "cargado_en"])
    store.kept(spark, base, "conteos", version, make)
    again = store.kept(spark, base, "conteos", version, lambda: make().withColumn("n", F.lit(-1).cast("bigint")))
    return again.select(*SERIES, "n", (F.col("n") >= 0).alias("reusado"))


@query("s29_index_round_trip", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 127, 0))) AS INTEGER)), ' ') AS codigo, CASE WHEN vec_id < 100 THEN 'historico' ELSE 'reciente' END AS parte FROM embeddings WHERE vec_id IS NOT NULL")
def _(spark, d):
    """Vectors written to the index by part, the recent part written once more, all read back from their codes."""
    path = _place(spark, "index")
    rows = table(spark, d, "embeddings").where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").alias("v"), F.when(F.col("vec_id") < 100, "historico").otherwise("reciente").alias("parte"))
    if rows.isEmpty():
        return rows.select("vec_id", F.lit("").alias("codigo"), "parte")
    index.write_index(rows, path, "hash:bag:64")
    index.write_index(rows.where("parte = 'reciente'"), path, "hash:bag:64")
    back = index.read_index(spark, path, "hash:bag:64")
    return back.select("vec_id", F.array_join(F.transform("v", lambda x: F.rint(x * 127).cast("int").cast("string")), " ").alias("codigo"), "parte")


@query("s30_kept_vectors", "SELECT doc_id, coalesce(length(text), 0) AS largo, lang IS NULL AS nuevo FROM documents WHERE doc_id IS NOT NULL")
def _(spark, d):
    """Vectors of texts kept by embedder; a second run embeds what is new only."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text", "lang")
    path = _place(spark, "vectors")
    first = index.embedded(docs.where("lang IS NOT NULL"), path, "hash", "bag", 16, "doc_id", "text")
    known = first.select("doc_id").distinct()
    every = index.embedded(docs, path, "hash", "bag", 16, "doc_id", "text")
    rows = every.join(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("largo")), "doc_id")
    return rows.join(known.withColumn("_k", F.lit(True)), "doc_id", "left").select("doc_id", "largo", F.col("_k").isNull().alias("nuevo"))


@query("s34_state", "SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, TRUE)) t(intento, hecho)")
def _(spark, d):
    """Three writers of one document: the one that saw an old version is refused."""
    path = _place(spark, "state")
    out = []
    for attempt, seen in ((1, 0), (2, 0), (3, 1)):
        try:
            store.swap(spark, path, seen, {"intento": attempt})
            out.append((attempt, True))
        except store.Conflict:
            out.append((attempt, False))
    return spark.createDataFrame(out, "intento int, hecho boolean")


@query("s23_series_lines", f"WITH {PX} SELECT concat('\"', replace(nombre_canonico, '\"', '\"\"'), ', kg\",', strftime(fecha, '%Y-%m-%d'), ',', p) AS linea FROM px JOIN productos ON productos.id = producto_id JOIN mercados ON mercados.id = mercado_id WHERE codigo = 'GMML' AND p IS NOT NULL")
def _(spark, d):
    """The series of the main market as lines of a CSV file; days without price have none."""
    rows = px(spark, d).where("p IS NOT NULL").join(table(spark, d, "mercados").where("codigo = 'GMML'").select(F.col("id").alias("mercado_id")), "mercado_id")
    rows = rows.join(table(spark, d, "productos").select(F.col("id").alias("producto_id"), "nombre_canonico"), "producto_id")
    path = _place(spark, "csv")
    store.write_csv(rows.select(F.concat("nombre_canonico", F.lit(", kg")).alias("producto"), F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "p"), path)
    return spark.read.text(path).where("value <> 'producto,fecha,p'").select(F.col("value").alias("linea"))


@query("s24_documents", f"WITH {PX}, k AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY producto_id, mercado_id) AS n FROM px) SELECT producto_id, mercado_id, strftime(fecha, '%Y-%m-%d') AS fecha, p FROM k WHERE i % CAST(ceil(n / 140) AS BIGINT) = 0 OR i = n - 1")
def _(spark, d):
    """The sampled series as JSON documents in a folder for each product, read back."""
    path = _place(spark, "documents")
    rows = windows.sampled(px(spark, d).select(*KEY, "p"), 140)
    if rows.isEmpty():
        return rows.withColumn("fecha", F.col("fecha").cast("string")).select("producto_id", "mercado_id", "fecha", "p")
    store.write_documents(rows.repartition("producto_id"), path, "producto_id")
    back = spark.read.schema("value string, producto_id int").text(path).withColumn("r", F.from_json("value", "mercado_id int, fecha string, p bigint"))
    return back.select("producto_id", "r.mercado_id", "r.fecha", "r.p")
