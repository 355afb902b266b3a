"""The queries of a price service, as functions of a Spark session and the folder of the tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions.questions import date_range, kinds_asked, mentions
from lonja.functions.text import normalised, slug
from lonja.operators import retrieval, windows
from lonja.operators.index import hashed
from lonja.operators.models import forecasted
from lonja.operators.series import SERIES
from lonja.plans.reference import VALUES, px
from lonja.session import table, written


class Ambiguous(ValueError):
    """A name that fits several products, or none; `options` are those it may mean."""

    def __init__(self, name: str, options: list[str]):
        super().__init__(f"{name!r} could be any of {options}" if options else f"no product is called {name!r}")
        self.options = options


def span(desde: str | None, hasta: str | None) -> tuple[date | None, date | None]:
    """Both dates checked: ISO, and in order."""
    a, b = (date.fromisoformat(x) if x else None for x in (desde, hasta))
    if a and b and a > b:
        raise ValueError(f"{a} is after {b}")
    return a, b


def parsed(asked: DataFrame, names: DataFrame, last: DataFrame) -> DataFrame:
    """Questions (pregunta, texto) read: productos and slugs (those named, null for none), tipos, desde, hasta.

    names: slug, nombre of the products; last: one row with the last date of the data, ultima.
    """
    named = mentions(asked, names, "pregunta", "texto", "slug", "nombre").groupBy("pregunta").agg(F.array_sort(F.collect_set("slug")).alias("productos"))
    when = asked.crossJoin(F.broadcast(last)).withColumn("_r", date_range("texto", "ultima"))
    return when.join(named, "pregunta", "left").select("pregunta", "texto", "productos", F.col("productos").alias("slugs"), kinds_asked("texto").alias("tipos"), "_r.desde", "_r.hasta")


def hybrid(docs: DataFrame, names: DataFrame, asked: DataFrame, last: DataFrame, k: int = 8) -> DataFrame:
    """pregunta, doc_id, rango, via: both searches within what each question (pregunta, texto) asks for, fused, and the floor."""
    read = written(retrieval.relaxed(parsed(asked, names, last), docs, "pregunta"), "questions")
    lexical = retrieval.bm25(docs.select("doc_id", "text", *retrieval.TEXT), read, "doc_id", "text", "pregunta", "texto", 40, filtered=True)
    vectors = hashed(docs, "doc_id", "text", more=retrieval.TEXT)
    wanted = hashed(read, "pregunta", "texto", more=retrieval.FILTER).withColumnRenamed("v", "w")
    dense = retrieval.nearest(vectors, wanted, "doc_id", "v", "pregunta", "w", 40, filtered=True)
    base = written(retrieval.floor(read, docs, "pregunta", "doc_id"), "floor").withColumn("via", F.lit("piso"))
    top = retrieval.fused([lexical, dense], "pregunta", "doc_id", k=k).join(base.select("pregunta", "doc_id"), ["pregunta", "doc_id"], "left_anti")
    return base.unionByName(top.select("pregunta", "doc_id", "rango", F.lit("busqueda").alias("via")))


@dataclass(frozen=True)
class Service:
    spark: SparkSession
    folder: str
    market: str = "GMML"

    def prices(self) -> DataFrame:
        markets = table(self.spark, self.folder, "mercados").where(F.col("codigo") == self.market).select(F.col("id").alias("mercado_id"))
        return px(self.spark, self.folder).join(markets, "mercado_id")

    def products(self, search: str | None = None) -> DataFrame:
        """id, nombre, slug of the products whose name holds the search, without case and accents; blank: all."""
        rows = table(self.spark, self.folder, "productos").select("id", F.col("nombre_canonico").alias("nombre"), slug("nombre_canonico").alias("slug"))
        if search and search.strip():
            rows = rows.where(F.contains(normalised("nombre"), normalised(F.lit(search))))
        return rows.orderBy("nombre")

    def product(self, name: str) -> int:
        """The id of the product that a slug, a name or a part of a name means."""
        asked = normalised(F.lit(name))
        rows = self.products().withColumn("n", normalised("nombre"))
        exact, held = (F.col("slug") == slug(F.lit(name))) | (F.col("n") == asked), F.contains(F.col("n"), asked)
        shared = F.size(F.array_intersect(F.split("n", " "), F.split(asked, " ")))
        found = rows.select("id", "nombre", F.when(exact, 3).when(held & (asked != ""), 2).when(shared > 0, 1).otherwise(0).alias("t"), shared.alias("s")).where("t > 0")
        top = found.orderBy(F.desc("t"), F.desc("s"), "nombre").limit(8).collect()
        best = [r for r in top if r.t == top[0].t] if top else []
        if len(best) == 1 and best[0].t >= 2 or best and best[0].t == 3:
            return best[0].id
        raise Ambiguous(name, [r.nombre for r in best])

    def coverage(self) -> DataFrame:
        return self.prices().agg(F.count("*").alias("filas"), F.countDistinct("fecha").alias("fechas"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.countDistinct("producto_id").alias("productos"))

    def current(self, name: str) -> DataFrame:
        """The last row of a product and its change against the price before it."""
        rows = self.prices().where(F.col("producto_id") == self.product(name)).where("p IS NOT NULL")
        return windows.latest(rows.withColumn("cambio", windows.change("p")))

    def series(self, name: str, desde: str | None = None, hasta: str | None = None) -> DataFrame:
        a, b = span(desde, hasta)
        rows = self.prices().where(F.col("producto_id") == self.product(name))
        rows = rows.where(F.col("fecha") >= a) if a else rows
        rows = rows.where(F.col("fecha") <= b) if b else rows
        return rows.select("fecha", "p", "m", "tendencia").orderBy("fecha")

    @staticmethod
    def summarised(rows: DataFrame) -> DataFrame:
        """n, minimo, maximo, media, desde, hasta, primero, ultimo of the rows with a price; no row without any."""
        out = rows.where("p IS NOT NULL").agg(
            F.count("*").alias("n"), F.min("p").alias("minimo"), F.max("p").alias("maximo"), F.try_divide(F.sum("p").cast("double"), F.count("*")).alias("media"),
            F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.min_by("p", "fecha").alias("primero"), F.max_by("p", "fecha").alias("ultimo"),
        )
        return out.where("n > 0")

    def summary(self, name: str, desde: str | None = None, hasta: str | None = None) -> DataFrame:
        return self.summarised(self.series(name, desde, hasta))

    def compare(self, names: list[str], last: int = 30) -> DataFrame:
        """Of each product over its last observations: last, least, greatest and mean price, and the change over them; no price last."""
        ids = [self.product(n) for n in names]
        rows = windows.tail(self.prices().where(F.col("producto_id").isin(ids)), "p", max(1, last))
        out = rows.groupBy("producto_id").agg(
            F.max_by("p", "fecha").alias("ultimo"), F.min("p").alias("minimo"), F.max("p").alias("maximo"), F.avg("p").alias("media"),
            F.try_divide(F.max_by("p", "fecha") - F.min_by("p", "fecha"), F.min_by("p", "fecha")).alias("cambio"), F.count("*").alias("n"),
        )
        asked = self.spark.createDataFrame([(i,) for i in ids], "producto_id int")
        return asked.join(out, "producto_id", "left").orderBy(F.asc_nulls_last("ultimo"))

    def anomalies(self, limit: int = 10) -> DataFrame:
        """The last price and the last mass of each product, where they are furthest from their history."""
        prices = self.prices()
        parts = [prices.where(F.col(c).isNotNull()).groupBy(*SERIES).agg(F.max("fecha").alias("fecha")).withColumn("tipo", F.lit(k)) for k, c in VALUES.items()]
        last = parts[0].unionByName(parts[1])
        rows = windows.anomalies(prices, VALUES).join(last, [*SERIES, "tipo", "fecha"], "left_semi")
        return rows.orderBy(F.desc(F.abs("z")), "producto_id", "tipo").limit(max(1, limit))

    def forecast(self, name: str, ahead: int = 1) -> DataFrame:
        """The forecast of the model that did best on the product so far, with its mean error, that of the
        plain one, whether it beats it, and what must be said with it."""
        rows = self.prices().where(F.col("producto_id") == self.product(name))
        made = forecasted(rows, "p", "m", ahead).withColumn("mejora", F.coalesce(F.col("mae") < F.col("mae_base"), F.lit(False)))
        better = F.when(F.col("mejora"), "Estimación, no un precio publicado; su error medio es menor que el del método simple.").otherwise("Estimación, no un precio publicado; el método simple no yerra más.")
        return made.withColumn("aviso", better)

    def markets(self) -> DataFrame:
        """The products of every other market on its own last day."""
        rows = px(self.spark, self.folder).withColumn("_f", F.max("fecha").over(Window.partitionBy("mercado_id"))).where("fecha = _f").drop("_f")
        others = table(self.spark, self.folder, "mercados").where(F.col("codigo") != self.market).select(F.col("id").alias("mercado_id"), "codigo")
        return rows.join(others, "mercado_id")

    def verification(self) -> DataFrame:
        """The other markets' prices of the main market's last day with a price, beside the main market's own."""
        rows = px(self.spark, self.folder).where("p IS NOT NULL").join(table(self.spark, self.folder, "mercados").select(F.col("id").alias("mercado_id"), "codigo"), "mercado_id")
        main = rows.where(F.col("codigo") == self.market)
        last = main.agg(F.max("fecha").alias("fecha"))  # one date
        own = main.join(F.broadcast(last), "fecha").select("producto_id", F.col("p").alias("g"))
        others = rows.where(F.col("codigo") != self.market).join(F.broadcast(last), "fecha").join(own, "producto_id", "left")
        apart = F.abs(F.try_divide((F.col("p") - F.col("g")).cast("double"), F.col("g").cast("double")))
        return others.select("mercado_id", "producto_id", "fecha", "p", "g", (apart <= 0.15).alias("coincide"))

    def retrieve(self, question: str, k: int = 8) -> DataFrame:
        """doc_id, rango, via, texto: what an answer to the question rests on, and the k texts that fit it best."""
        docs = table(self.spark, self.folder, "documents")
        names = self.products().where("slug IS NOT NULL").select("slug", "nombre").dropDuplicates(["slug"])
        asked = self.spark.createDataFrame([(0, question)], "pregunta int, texto string")
        last = table(self.spark, self.folder, "precios_diarios").agg(F.max("fecha").alias("ultima"))
        found = hybrid(docs, names, asked, last, k)
        return found.join(docs.select("doc_id", F.col("text").alias("texto")), "doc_id").select("doc_id", "rango", "via", "texto")

    def day(self) -> DataFrame:
        """The three products that rose and fell most on the last day, and the day's mass."""
        rows = self.prices().withColumn("cambio", windows.change("p"))
        last = rows.join(F.broadcast(rows.agg(F.max("fecha").alias("fecha"))), "fecha")
        three = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, 3)
        return last.groupBy("fecha").agg(
            F.sum("m").alias("masa"),
            three(F.when(F.col("cambio") > 0, F.struct((-F.col("cambio")).alias("c"), "producto_id"))).getField("producto_id").alias("suben"),
            three(F.when(F.col("cambio") < 0, F.struct(F.col("cambio").alias("c"), "producto_id"))).getField("producto_id").alias("bajan"),
        )
