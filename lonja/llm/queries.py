"""Queries of the text problems (p5, p8, p9, p10), and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.canonical import map_names
from lonja.llm.packing import containers
from lonja.llm.spans import classes, repeats, shared_spans, shares
from lonja.llm.tokens import decoded, token_counts, token_ids
from lonja.session import table

#: Regional names of kinds of produce.
REGIONAL = {
    "aji": ["chile"],
    "arveja": ["guisante", "alverja", "chicharo"],
    "betarraga": ["remolacha", "betabel"],
    "brocoli": ["brecol"],
    "caigua": ["achocha"],
    "camote": ["batata", "boniato"],
    "col": ["repollo"],
    "culantro": ["cilantro", "coriandro"],
    "fresa": ["frutilla"],
    "frijol": ["poroto", "frejol", "alubia", "judia"],
    "kion": ["jengibre"],
    "maiz choclo": ["elote", "choclo", "jojoto"],
    "maracuya": ["parchita"],
    "mashua": ["cubio"],
    "olluco": ["ulluco", "papalisa", "melloco"],
    "palta": ["aguacate"],
    "papa": ["patata"],
    "papaya": ["lechosa"],
    "pepinillo": ["pepino"],
    "pimiento": ["morron"],
    "pina": ["anana", "ananas"],
    "platano": ["banano", "banana", "guineo"],
    "poro": ["puerro"],
    "rabanito": ["rabano"],
    "rocoto": ["locoto"],
    "sandia": ["patilla"],
    "tomate": ["jitomate"],
    "vainita": ["ejote", "chaucha", "habichuela"],
    "yuca": ["mandioca"],
    "zapallo": ["calabaza", "auyama"],
}

# -- p5: free product names ---------------------------------------------------------------------


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report row with the product its name means, or none, all nearest products and all within the distance allowed."""
    rows = table(spark, sf_dir, "filas_reporte").select("fila_id", "producto", "unidad", "equiv_kg")
    context = {"equiv_kg": "equiv_kg", "unidad": "unidad_default"}
    mapped = map_names(rows, "producto", table(spark, sf_dir, "productos"), ("id", "nombre_canonico"), REGIONAL, context)
    return mapped.select("fila_id", "producto", F.col("entrada").alias("producto_id"), "distancia", "candidatos", "dentro")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_mapped(spark, sf_dir).where("producto_id IS NOT NULL").select("fila_id", "producto_id")


# -- p8: token ids ------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return decoded(p8_ids(spark, sf_dir))


# -- p9: containers -----------------------------------------------------------------------------


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, or part of a text over 2,048 tokens, in its container of 2,048 tokens."""
    return containers(token_counts(table(spark, sf_dir, "documents")))


# -- p10: shared spans --------------------------------------------------------------------------


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeat of each document, with the least document and place where it stands."""
    return classes(repeats(table(spark, sf_dir, "documents")))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text stands verbatim in another document."""
    docs = table(spark, sf_dir, "documents")
    return shares(docs, shared_spans(docs))


QUERIES = {"p5_mapped": p5_mapped, "p5_found": p5_found, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p10_found": p10_found, "p10_classes": p10_classes, "p10_shares": p10_shares}
#: Shared spans by all windows of 200 characters; quadratic in the length of a text.
_SPANS = """t AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200), w AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS h FROM t),
 s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), c AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN s ON s.h = w.h),
 o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS abre FROM c), g AS (SELECT doc_id, i, sum(abre) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
 spans AS (SELECT doc_id, min(i) AS inicio, max(i) + 200 AS fin FROM g GROUP BY doc_id, k)"""

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_found": f"WITH {_SPANS} SELECT * FROM spans",
    "p10_shares": f"""WITH {_SPANS}, n AS (SELECT doc_id, CAST(sum(fin - inicio) AS BIGINT) AS n FROM spans GROUP BY doc_id)
 SELECT doc_id, coalesce(length(text), 0) AS caracteres, coalesce(n, 0) AS compartidos, CASE WHEN length(text) > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / length(text) END AS parte FROM documents LEFT JOIN n USING (doc_id)""",
}
