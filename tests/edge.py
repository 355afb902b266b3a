"""Folders of awkward tables: the test tables emptied, with nulls in every column, with further columns."""

from pyspark.sql import functions as F

from oracle import DATA

TABLES = "mercados productos unidades precios_diarios reportes filas_reporte fuentes_raw documents embeddings events".split()
#: Names that the operators use for columns of their own.
CLASHING = "_kg _hundredths _anchor _held _version _v _d _h _t _p _w _tile _before _source _days _named _container n k pos word ids h g p m z marca perfil firma entrada rango".split()


def emptied(spark, folder):
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


def with_nulls(spark, folder):
    """Every table with a row of nulls only, and for each column some rows in which it alone is null, all twice."""
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        some = df.limit(200)
        rows = some
        for c in df.columns:
            rows = rows.unionByName(df.limit(3).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        rows = rows.unionByName(df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
        rows.unionByName(rows).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


def with_more_columns(spark, folder):
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns}).write.parquet(f"{folder}/{t}.parquet")
    return folder
