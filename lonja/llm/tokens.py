"""Token ids of a whole corpus through a table of its distinct words, and back again."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lonja.operators.series import Block, map_series
from lonja.operators.skew import SHARE
from lonja.session import written

#: Where the vocabularies lie; a parameter of every function here.
FOLDER = os.environ.get("LONJA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text into the words that byte pair merges stay within,
#: with Unicode white space (U) as the tokenizer has it.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest word, in characters, in the table of frequent words; longer frequent ones join by key and salt.
LONGEST = 64
#: Parts that the rows of a long frequent word are spread over.
SALTS = 64
#: Key of a text in joins: 128 bits of hash over key and text, so that no two of even 10^12 texts meet.
TEXT = ["_h", "_g"]


def read_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """Pieces of a byte-level vocabulary and their ids."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words(text: str | Column) -> Column:
    """The words of a text in order; joined they are the text again. Null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORDS), F.lit(0))


def encoded_words(docs: DataFrame, text: str, name: str, folder: str) -> DataFrame:
    """word, n (occurrences), ids: each distinct word once. Written to the shared folder."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            ids = [encoding._encode_single_piece(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    distinct = docs.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return written(distinct.mapInArrow(encode, "word string, n bigint, ids array<int>"), "words")


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start[i]:start[i] + size[i]] for each i, one after the other, and i of each."""
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    return values[start[of] + at], of


def lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values.astype(np.int32)))


def numbered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, length of each list) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def parts(docs: DataFrame, key: str, text: str, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rare): what is known of each text by its frequent words, and the ids of its rare ones.

    texts: key, _h, _g (hash of key and text), ids, cola. A frequent word stands in ids by its own ids; the
    k-th rare word of the text (from 0) by -1 - k, and its string in cola. Frequent words have at least
    SHARE of all occurrences, so there are at most 1 / SHARE of them, each of up to LONGEST characters:
    that table goes to every task. rare: _h, _g, k, ids, by a join of the words of cola with the table of
    distinct words. The rows of a frequent word that is longer (a ruled line) are spread over SALTS parts,
    to each of which the word's ids go; which words those are is told by at most 1 / SHARE hashes.
    """
    table = encoded_words(docs, text, name, folder)
    total = table.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(1.0, total * SHARE)
    frequent = often & (F.length("word") <= LONGEST)
    long_ones = [r[0] for r in table.where(often & ~frequent).select(F.xxhash64("word")).limit(int(1 / SHARE) + 1).collect()]
    head = table.where(frequent).select("word", "ids").orderBy("word").limit(int(1 / SHARE) + 1).collect()
    known = docs.sparkSession.sparkContext.broadcast(([r.word for r in head], [r.ids for r in head]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(known.value[0], pa.string())
        own_size = np.array([len(x) for x in known.value[1]] + [0], np.int64)
        own = np.array([i for x in known.value[1] for i in x] + [0], np.int64)
        own_start = np.cumsum(own_size) - own_size
        for b in batches:
            column = b.column("_w")
            words_of = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            index = pc.index_in(flat, value_set=strings).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), words_of)
            rare = index < 0
            rare_of = np.bincount(doc, rare, b.num_rows).astype(np.int64)
            before = np.cumsum(rare_of) - rare_of
            turn = np.cumsum(rare) - 1 - before[doc]
            size = np.where(rare, 1, own_size[index])
            # The ids of all words, frequent ones from the table; the places of rare ones are set after.
            got, of = spread(own, np.where(rare, 0, own_start[index]), size)
            got = np.where(rare[of], -1 - turn[of], got)
            ids = lists(got, np.bincount(doc, size, b.num_rows).astype(np.int64))
            tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare_of)].astype(np.int32)), flat.filter(pa.array(rare)))
            yield pa.RecordBatch.from_arrays([b.column(key), *(b.column(c) for c in TEXT), ids, tail], names=[key, *TEXT, "ids", "cola"])

    kind = dict(docs.dtypes)[key]
    split = docs.select(F.col(key), F.xxhash64(key, text).alias("_h"), F.xxhash64(F.lit(1), text, key).alias("_g"), words(text).alias("_w"))
    texts = written(split.mapInArrow(look_up, f"{key} {kind}, _h bigint, _g bigint, ids array<int>, cola array<string>"), "texts")
    tail = texts.where(F.size("cola") > 0).select(*TEXT, F.posexplode("cola").alias("k", "word"))
    rest, on = table.where(~frequent).select("word", "ids"), ["word"]
    if long_ones:
        spread_out = (F.length("word") > LONGEST) & F.xxhash64("word").isin(long_ones)
        tail = tail.withColumn("_part", F.when(spread_out, F.pmod(F.hash(*TEXT, "k"), F.lit(SALTS))).otherwise(0))
        rest = rest.withColumn("_part", F.explode(F.when(spread_out, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on.append("_part")
    return texts, tail.join(rest, on).select(*TEXT, "k", "ids")


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, ids (array<int>): the ids of each text, without special tokens; one row for each row of docs.

    Strings of special tokens are ordinary text. Null and empty texts have the empty list. Repeated rows,
    null keys, and one key with several texts are all kept. Other columns are not read. Texts with rare
    words meet the ids of those by a hash of key and text, and are streamed; memory holds some at a time.
    """
    texts, rare = parts(docs, key, text, name, folder)
    whole = texts.where(F.size("cola") == 0).select(key, "ids")
    open_ = texts.where(F.size("cola") > 0).select(key, *TEXT, F.lit(-1).alias("k"), "ids")
    rows = open_.unionByName(rare.select(F.lit(None).cast(docs.schema[key].dataType).alias(key), *TEXT, "k", "ids"))

    def fill(b: Block) -> dict[str, pa.Array | pa.ChunkedArray]:
        k, series = b["k"], b.series
        values, size = numbered(b.columns.column("ids"))
        start = np.cumsum(size) - size
        is_text = k < 0
        # Repeated rows bring their rare words as often; each (series, k) once.
        once = ~is_text & np.r_[True, (k[1:] != k[:-1]) | (series[1:] != series[:-1])]
        word = np.flatnonzero(once)
        first = np.searchsorted(series[word], np.arange(len(b.starts)))
        text_row = np.flatnonzero(is_text)
        v, of = spread(values, start[text_row], size[text_row])
        gap = v < 0
        row = np.zeros(len(v), np.int64)
        row[gap] = word[first[series[text_row[of[gap]]]] - 1 - v[gap]]
        # Each place is one id, or the ids of a rare word.
        joined = np.r_[v, values]
        got, place = spread(joined, np.where(gap, len(v) + start[row], np.arange(len(v))), np.where(gap, size[row], 1))
        count = np.bincount(of[place], minlength=len(text_row)).astype(np.int64)
        return {key: b.columns.column(key).take(pa.array(text_row)), "ids": pa.chunked_array([lists(got, count)])}

    out = StructType([StructField(key, docs.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])
    return whole.unionByName(map_series(rows, fill, out, keys=TEXT, order="k"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, tokens: how many ids each text has; one row for each row of docs, as in `token_ids`.

    Rare words are summed before the shuffle; no list of ids is built from them.
    """
    texts, rare = parts(docs, key, text, name, folder)
    # Identical repeated rows add up to a multiple, as many times as their first rare word comes.
    sums = rare.groupBy(*TEXT).agg((F.sum(F.size("ids")) / F.count_if(F.col("k") == 0)).cast("bigint").alias("_s"))
    own = F.size("ids") - F.size("cola")
    return texts.select(key, *TEXT, own.alias("_o")).join(sums, TEXT, "left").select(key, (F.col("_o") + F.coalesce("_s", F.lit(0))).cast("bigint").alias("tokens"))


def repeated(b: Block) -> np.ndarray:
    """Rows that say again what the row before says: the words of an identical row."""
    pos = b["pos"]
    return np.r_[False, (pos[1:] == pos[:-1]) & (b.series[1:] == b.series[:-1])]


def pieces(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """id, piece: the vocabulary, whose size does not depend on the corpus."""
    return spark.createDataFrame([(i, bytearray(p)) for p, i in read_ranks(name, folder).items()], "id int, piece binary")


def decoded(encoded: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, text of each list of ids, by a join of ids with pieces. Unknown ids raise no error and give no text."""
    spark = encoded.sparkSession
    rows = encoded.select(key, F.xxhash64(key, "ids").alias("_h"), F.xxhash64(F.lit(1), "ids", key).alias("_g"), F.posexplode("ids").alias("pos", "id"))
    found = rows.join(F.broadcast(pieces(spark, name, folder)), "id")

    def join(b: Block) -> dict[str, pa.ChunkedArray]:
        parts, keep = b.columns.column("piece").to_pylist(), ~repeated(b)
        texts = [b"".join(p for p, k in zip(parts[i:j], keep[i:j]) if k).decode("utf-8", "replace") for i, j in zip(b.starts, b.ends)]
        return {key: b.columns.column(key).take(pa.array(b.starts)), "text": pa.chunked_array([pa.array(texts, pa.string())])}

    out = StructType([StructField(key, encoded.schema[key].dataType), StructField("text", StringType())])
    empty = encoded.where(F.size("ids") == 0).select(key, F.lit("").alias("text"))
    return map_series(found.drop("id"), join, out, keys=TEXT, order="pos").unionByName(empty)
