"""Tables on shared storage: idempotent upserts, intake of files, exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lonja.operators.series import holding_rows
from lonja.session import written


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table lies there, without making it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Conflict(RuntimeError):
    """Another writer was first, or one ended in the midst of its write."""


def _log(spark: SparkSession, path: str):
    """File system, and the folder of the versions of what lies at path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}__log")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _child(spark: SparkSession, folder, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)


def state(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The latest version of a small document and the document; (0, None) before the first."""
    fs, folder = _log(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    last = max((int(n) for n in names if n.isdigit()), default=0)
    if not last:
        return 0, None
    stream = fs.open(_child(spark, folder, f"{last:09d}"))
    try:
        return last, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def swap(spark: SparkSession, path: str, seen: int, document: dict) -> int:
    """Compare and swap: write the version after `seen`, unless another writer already has (Conflict).

    The file of a version is made only if there is none, which the file system decides.
    """
    fs, folder = _log(spark, path)
    fs.mkdirs(folder)
    try:
        out = fs.create(_child(spark, folder, f"{seen + 1:09d}"), False)
    except Exception as e:
        raise Conflict(f"version {seen + 1} of {path} exists") from e
    out.write(bytearray(json.dumps(document).encode()))
    out.close()
    return seen + 1


def finish(spark: SparkSession, path: str) -> None:
    """Carry out what the last writer had decided on but not ended; nothing if it had."""
    last, plan = state(spark, path)
    fs, folder = _log(spark, path)
    if not plan or fs.exists(_child(spark, folder, f"{last:09d}.done")):
        return
    known = spark.read.parquet(plan["staged"]).schema
    # Months are text, whatever the names of the folders look like.
    schema = StructType([StructField(f.name, StringType()) if f.name == "mes" else f for f in known])
    fresh = spark.read.schema(schema).parquet(plan["staged"])
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mes").parquet(path)
    for month in plan["emptied"]:
        fs.delete(_child(spark, _child(spark, folder.getParent(), path.rstrip("/").rsplit("/", 1)[-1]), f"mes={month or '__HIVE_DEFAULT_PARTITION__'}"), True)
    fs.create(_child(spark, folder, f"{last:09d}.done"), True).close()
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(plan["staged"]), True)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], version: str, date: str) -> None:
    """Bring rows into the table at path: of each key the latest version holds, whatever the order of arrival.

    The table is partitioned by the month of `date` (null dates have a partition of their own); only
    the months that rows touch are read and written again, so a run costs what it changes. A key whose
    date has moved to another month is taken out of the old one; where the date is part of the key it
    can't move, else the table's keys are searched for it. The same rows twice change nothing.

    The new months are staged first; then the run becomes the table's next version by `swap`, and only
    then is the table changed. A run that another one overtook raises Conflict and has changed nothing.
    A run that ended in between is carried out by `finish`, without which later runs raise Conflict.
    """
    seen, _ = state(spark, path)
    fs, log = _log(spark, path)
    if seen and not fs.exists(_child(spark, log, f"{seen:09d}.done")):
        raise Conflict(f"version {seen} of {path} is not carried out; finish() does that")
    rows = written(rows.withColumn("mes", F.date_format(date, "yyyy-MM")), "incoming")
    touched = rows.select("mes")
    old = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else rows.limit(0)
    if date not in keys:
        asked = rows.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= old[k].eqNullSafe(asked[f"_{i}"])
        touched = touched.unionByName(old.join(asked, same, "left_semi").select("mes"))
    months = {r.mes for r in touched.distinct().collect()}  # a run touches few months
    if not months:
        return
    here = F.col("mes").isin(*[m for m in months if m]) | (F.col("mes").isNull() & F.lit(None in months))
    merged = holding_rows(old.where(here).unionByName(rows), keys, version, [version, *[c for c in rows.columns if c not in keys and c != version]])
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    merged.write.partitionBy("mes").parquet(staged)
    kept = {r.mes for r in spark.read.schema(merged.schema).parquet(staged).select("mes").distinct().collect()}
    try:
        swap(spark, path, seen, {"staged": staged, "emptied": sorted(months - kept, key=str)})
    except Conflict:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), True)
        raise
    finish(spark, path)


#: The tables of the store.
SCHEMAS = {
    "mercados": "id int, codigo string, nombre string",
    "productos": "id int, nombre_canonico string, categoria string, unidad_default string, equiv_kg double",
    "precios_diarios": "fecha date, mercado_id int, producto_id int, masa_hoy double, precio_hoy_kg double, tendencia string, fuente string, cargado_en timestamp",
    "pronosticos": "producto_id int, mercado_id int, fecha date, horizonte int, bajo double, alto double, metodo string",
    "fuentes_raw": "id int, fuente string, fecha date, url string, sha256 string, bytes int, descargado_en timestamp",
}


def create(spark: SparkSession, base: str) -> None:
    """The store's tables below base, each made empty where it is absent; what is there is not touched."""
    for name, schema in SCHEMAS.items():
        if not exists(spark, f"{base}/{name}"):
            spark.createDataFrame([], StructType.fromDDL(schema)).write.mode("ignore").parquet(f"{base}/{name}")


def with_ids(known: DataFrame, named: DataFrame, name: str, key: str) -> DataFrame:
    """name, key: the known names with their ids, and every further name of `named` with one after the greatest.

    Names of a dimension: new ones are numbered in their order, in one task. Null names get none.
    """
    new = named.where(F.col(name).isNotNull()).select(name).distinct().join(known, name, "left_anti")
    last = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))  # one row
    numbered = new.withColumn("_n", F.row_number().over(Window.orderBy(name))).crossJoin(F.broadcast(last))
    return known.select(name, key).unionByName(numbered.select(name, (F.col("_last") + F.col("_n")).cast(known.schema[key].dataType).alias(key)))


def upsert_forecasts(spark: SparkSession, path: str, rows: DataFrame, version: str) -> None:
    """Bring forecasts into the table at path, one for each product, market, day and horizon.

    rows: producto_id, mercado_id, fecha, horizonte (1 if null), intervalo (array of two), `version`.
    """
    flat = rows.select("producto_id", "mercado_id", "fecha", F.coalesce("horizonte", F.lit(1)).alias("horizonte"), F.get("intervalo", F.lit(0)).alias("bajo"), F.get("intervalo", F.lit(1)).alias("alto"), version)
    upsert(spark, path, flat, ["producto_id", "mercado_id", "fecha", "horizonte"], version, "fecha")


def version_of(df: DataFrame, columns: Sequence[str]) -> str:
    """A version of a table's data: its rows and the sum of their hashes, whatever their order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("h")).first()
    return f"{r.n}-{(r.h or '0').lstrip('-')}"


def kept(spark: SparkSession, base: str, name: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result kept for a version of the data: read if it is there and whole, else made and kept.

    It is written aside and moved to its place when it is whole, so a writer that ends midway leaves
    nothing that could be read; if two make it at once, the first one's stays.
    """
    path = f"{base.rstrip('/')}/{name}/{version}"
    if not exists(spark, f"{path}/_SUCCESS"):
        aside = f"{base.rstrip('/')}/_aside-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        jvm = spark.sparkContext._jvm
        place, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(place) and not exists(spark, f"{path}/_SUCCESS"):
            fs.delete(place, True)  # what a broken copy left
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, True)
    return spark.read.parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upserts have made at path; empty before the first row."""
    return spark.read.schema(schema).parquet(path).select(*schema.names) if exists(spark, path) else spark.createDataFrame([], schema)


def insert_new(known: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not known yet, each key once (the least row)."""
    rest = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    return once.join(known.select(*keys).distinct(), list(keys), "left_anti")


def files(spark: SparkSession, path: str, magic: str = "%PDF-", pattern: str = "*") -> DataFrame:
    """path, bytes, sha256, valido of each file below path: contents are hashed where they lie, and not kept."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, len(magic)) == F.lit(magic).cast("binary")).alias("valido"))


def links(pages: DataFrame, html: str, pattern: str, order: Sequence[str]) -> DataFrame:
    """enlace: the links in the pages that match a pattern, each once, at its first place."""
    found = pages.select(*order, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("_i", "enlace"))
    return found.groupBy("enlace").agg(F.min(F.struct(*order, "_i")).alias("_at")).orderBy("_at").select("enlace")


@dataclass(frozen=True)
class Collection:
    """A source's index on the web: its name, address, the pattern of its month pages, and the name its rows go by."""

    name: str
    url: str
    months: str
    source: str


#: The two collections that the navigation is made for.
COLLECTIONS = {
    "mayorista": Collection("mayorista", "/coleccion", r"/mes/\d{4}-\d{2}", "reporte"),
    "regional": Collection("regional", "/coleccion-regional", r"/regional/mes/\d{4}-\d{2}", "regional"),
}


def month_pages(sheets: DataFrame, collection: Collection, most: int | None = None) -> DataFrame:
    """enlace, lugar: the month pages linked in the sheets (hoja, html) of a collection's index, each at its first place.

    Sheets count up to the first one that has no page which an earlier one had not.
    """
    found = sheets.select("hoja", F.posexplode(F.regexp_extract_all("html", F.lit(collection.months), F.lit(0))).alias("_i", "enlace"))
    first = found.groupBy("enlace").agg(F.min(F.struct("hoja", "_i")).alias("_at"))
    news = sheets.select("hoja").distinct().join(first.select(F.col("_at.hoja").alias("hoja")).distinct().withColumn("_new", F.lit(True)), "hoja", "left")
    stop = news.agg(F.min(F.when(F.col("_new").isNull(), F.col("hoja"))).alias("_stop"))  # one row
    held = first.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("_at.hoja") < F.col("_stop")))
    # The pages of an index: as many as months.
    out = held.select("enlace", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("lugar"))
    return out.where(F.col("lugar") <= most) if most else out


def last_of_each(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n last rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def write_csv(df: DataFrame, path: str) -> None:
    """With header; fields are quoted where they must be, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON document a line, without null fields; a folder for each value of `by`."""
    out = df.select(*([by] if by else []), F.to_json(F.struct(*[c for c in df.columns if c != by])).alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)
