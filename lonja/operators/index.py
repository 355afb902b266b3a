"""An index of texts and their vectors on shared storage: hashed embeddings, int8 codes, closed and open parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lonja.functions import vectors as vec
from lonja.functions.formats import signature_file
from lonja.functions.text import tokens
from lonja.session import ship
from lonja.sources.store import exists


def hashed(docs: DataFrame, key: str, text: str, dims: int = 64, more: Sequence[str] = ()) -> DataFrame:
    """key, v, and the columns `more`: a bag of hashed tokens, of length 1 (all zero without tokens of three letters or more).

    Each token adds 1 or -1, by the parity of a further byte of its hash, to one of `dims` places.
    """
    kinds = dict(docs.dtypes)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[int, int]] = {}
        for b in batches:
            out = np.zeros((b.num_rows, dims))
            for i, words in enumerate(b.column("_t").to_pylist()):
                for w in words or ():
                    if len(w) < 3:
                        continue
                    if w not in places:
                        if len(places) > 200_000:
                            places.clear()
                        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                        places[w] = int.from_bytes(h[:7], "big") % dims, 1 - 2 * (h[7] & 1)
                    at, sign = places[w]
                    out[i, at] += sign
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(norm > 0, norm, 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims), pa.array(out.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(key), lists, *[b.column(c) for c in more]], names=[key, "v", *more])

    return docs.select(key, tokens(text).alias("_t"), *more).mapInArrow(embed, ", ".join([f"{key} {kinds[key]}", "v array<float>", *[f"{c} {kinds[c]}" for c in more]]))


def closed(end: str | Column, last: Column) -> Column:
    """Whether a period ended before the week of the last data began; such parts never change."""
    end = F.col(end) if isinstance(end, str) else end
    return F.coalesce(end < F.trunc(last, "week"), F.lit(False))


def write_index(chunks: DataFrame, path: str, signature: str, vector: str = "v", part: str = "parte") -> None:
    """Write chunks with their vectors as int8 codes, by part; only the parts that chunks holds are replaced.

    An index by an embedder for tests ("fake:...", "local:...") is refused.
    """
    if signature.startswith(("fake:", "local:")):
        raise ValueError(f"{signature} is no embedder to publish an index by")
    rows = chunks.withColumn("codigo", vec.quantised(vector)).drop(vector).withColumn("firma", F.lit(signature))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def read_index(spark: SparkSession, path: str, signature: str, vector: str = "v") -> DataFrame:
    """The chunks of all parts with their vectors; refused if any was made by another embedder."""
    rows = spark.read.parquet(path)
    others = [r.firma for r in rows.select("firma").distinct().limit(2).collect() if r.firma != signature]
    if others:
        raise ValueError(f"the index was made by {others[0]}, not by {signature}")
    return rows.withColumn(vector, vec.restored("codigo")).drop("codigo", "firma")


def missing(chunks: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks whose text is not embedded yet, by key and hash of the text."""
    ship(chunks.sparkSession)
    mark = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return chunks.withColumn("huella", mark).join(known.select(key, "huella").distinct(), [key, "huella"], "left_anti")


def embedded(chunks: DataFrame, base: str, provider: str, model: str, dims: int, key: str, text: str) -> DataFrame:
    """key, huella, v of every chunk, from the vectors kept for this embedder; those that lack one are embedded and kept.

    Each embedder has a folder of its own. New vectors are appended as a batch that is either whole or
    absent, so a run that ends midway costs no more than its own batch.
    """
    spark = chunks.sparkSession
    path = f"{base.rstrip('/')}/{signature_file(provider, model, dims)}"
    empty = StructType([StructField(key, chunks.schema[key].dataType), *StructType.fromDDL("huella string, v array<float>").fields])
    known = spark.read.schema(empty).parquet(path) if exists(spark, path) else spark.createDataFrame([], empty)
    new = missing(chunks.select(key, text), known, key, text).dropDuplicates([key, "huella"])
    vectors = hashed(new, key, text, dims).join(new.select(key, "huella"), key)
    vectors.select(key, "huella", "v").write.mode("append").parquet(path)
    wanted = chunks.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("huella")).distinct()
    return spark.read.schema(empty).parquet(path).join(wanted, [key, "huella"], "left_semi")
