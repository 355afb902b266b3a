"""Lexical, vector and fused retrieval as plans over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import normalised, tokens
from lonja.session import written

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, key, tf, largo: how often each token stands in each text, and the text's length in tokens."""
    rows = docs.select(key, tokens(text).alias("_t")).withColumn("largo", F.size("_t"))
    return rows.select(key, "largo", F.explode("_t").alias("token")).groupBy("token", key, "largo").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, question: str, k: int = 10, allowed: Callable[[DataFrame], DataFrame] | None = None, block: int = 512, filtered: bool = False) -> DataFrame:
    """query, key, bm25, rango: the k texts that best match each question.

    Okapi weights with idf = ln(1 + (N - df + 0.5) / (df + 0.5)), over distinct tokens of a question.
    Ranked by score in steps of 1e-9, then key. allowed keeps those of the rows (query, key) that may be
    found; N, df and the mean length stay those of all texts. Rows with a null key are left out.

    Texts are split into tokens once. What a text keeps of itself is how often each token of any question
    stands in it. Questions with the same tokens are asked once, and in blocks against all texts: a task
    holds the lists of its texts by token, adds up a block's scores over them, and only the best k for
    each question leave it, so no row stands for a text and a question that it merely shares a word with.
    Under `allowed`, which may leave any of them, all that share a word do. filtered: texts have the columns of
    a text and questions those of a filter as in `accepts`, and only texts that a question's filter accepts
    are found; where they lie, so that no more leaves a task than without filter, and a block of texts of one
    slug meets only the questions that ask for it or for none.
    """
    kind, asking = dict(docs.dtypes)[key], dict(queries.dtypes)[query]
    about, asks_for = (TEXT, FILTER) if filtered else ((), ())
    split = written(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_d"), tokens(text).alias("_t"), *about), "tokens")
    size = split.agg(F.count("*").alias("_docs"), F.sum(F.greatest(F.size("_t"), F.lit(0))).alias("_n"))
    asked = written(queries.select(F.col(query).alias("_q"), F.array_sort(F.array_distinct(tokens(question))).alias("_w"), *asks_for).where(F.size("_w") > 0), "asked")
    vocabulary = asked.select(F.explode("_w").alias("token")).distinct()
    frequency = split.select(F.explode(F.array_distinct("_t")).alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("_df"))
    idf = F.ln(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = frequency.crossJoin(F.broadcast(size)).select("token", idf.alias("_idf"), (F.col("_n") / F.col("_docs")).alias("_mean"))
    # The stated questions in blocks, each with its tokens and their weights.
    what = ["_w", *([F.to_json(F.struct(*asks_for))] if filtered else [])]
    named = F.xxhash64(*what).alias("_h"), F.xxhash64(F.lit(1), *what).alias("_g")
    once = asked.groupBy("_w", *asks_for).agg(F.min(F.struct("_q")).alias("_one")).select("_w", *asks_for, *named)
    count = max(1, -(-once.count() // block))
    terms = once.select("_h", "_g", *asks_for, F.explode("_w").alias("token")).join(weights, "token")
    if filtered:
        terms = _sized(once.select("_h", "_g", _asked_slug()), "_s", "_h", block).join(terms, ["_h", "_g"])
    else:
        terms = terms.withColumn("_b", F.pmod("_h", F.lit(count)))
    of_slug = ["_s"] * filtered
    blocks = terms.groupBy("_b", *of_slug).agg(F.collect_list(F.struct("_h", "_g", "token", "_idf", "_mean", *asks_for)).alias("_x"))
    blocks = blocks.select(*of_slug, *[F.col(f"_x.{c}").alias(c) for c in ("_h", "_g", "token", "_idf", "_mean", *asks_for)])

    most = None if allowed else k

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                yield _best({c: b.column(c)[r].values for c in b.schema.names if c not in ("_s", "_slug")}, key, most)

    # Blocks of texts of some thousand texts and some hundred thousand tokens.
    whole = size.first()
    some = split.where(F.size("_t") > 0)
    if filtered:
        some = _sized(some.withColumn("_slug", F.col("slug")), "_slug", "_d", min(4096, max(1, 500_000 * whole._docs // max(1, whole._n or 0))))
    else:
        some = some.withColumn("_b", F.pmod(F.xxhash64("_d"), F.lit(max(1, -(-whole._docs // 4096), -(-(whole._n or 0) // 500_000)))))
    in_slug = ["_slug"] * filtered
    held = some.groupBy("_b", *in_slug).agg(F.collect_list(F.struct("_d", "_t", *about)).alias("_x")).select(*in_slug, *[F.col(f"_x.{c}").alias(c) for c in ("_d", "_t", *about)])
    met = held.repartition(F.xxhash64("_d")).crossJoin(blocks)
    found = (met.where("_s IS NULL OR _s = _slug") if filtered else met).mapInArrow(score, f"_h bigint, _g bigint, {key} {kind}, _s bigint")
    asks = asked.select("_q", *named)
    total = found.join(asks, ["_h", "_g"]).select(F.col("_q").cast(asking).alias(query), key, "_s")
    total = allowed(total) if allowed else total
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_s"), key))
    return total.withColumn("rango", rank).where(F.col("rango") <= k).select(query, key, (F.col("_s") / 1e9).alias("bm25"), "rango")


def _best(column: dict[str, pa.Array], key: str, k: int | None) -> pa.RecordBatch:
    """_h, _g, key, _s of the k best texts (all, if None) of a block for each question of a block."""
    token, idf = column["token"], column["_idf"].to_numpy()
    asked = np.stack([column["_h"].to_numpy(), column["_g"].to_numpy()])
    ids, one, of = np.unique(asked, axis=1, return_index=True, return_inverse=True)
    ok = _accepted({c: column[c].take(pa.array(one)) for c in FILTER}, {c: column[c] for c in TEXT}) if FILTER[0] in column else None
    words, word = np.unique(token.to_numpy(zero_copy_only=False), return_inverse=True)
    keys, lists = column["_d"], column["_t"]
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.index_in(lists.flatten(), value_set=pa.array(words)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(keys)), size)[flat >= 0]
    # How often each word stands in each text, by word.
    hit, tf = np.unique(flat[flat >= 0] * len(keys) + doc, return_counts=True)
    hit_word, hit_doc = np.divmod(hit, len(keys))
    first = np.searchsorted(hit_word, np.arange(len(words) + 1))
    weight = np.zeros(len(words))
    weight[word] = idf
    mean = column["_mean"][0].as_py()
    norm = 1 - B + B * size / mean
    part = weight[hit_word] * tf * (K1 + 1) / (tf + K1 * norm[hit_doc])
    points = np.floor(part * 1e9 + 0.5).astype(np.int64)
    order = keys.to_numpy(zero_copy_only=False)
    by_question = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[by_question], np.arange(ids.shape[1] + 1))
    took, scores, question = [], [], []
    for q in range(ids.shape[1]):
        sums = np.zeros(len(keys), np.int64)
        for w in word[by_question[edges[q] : edges[q + 1]]]:
            at = slice(first[w], first[w + 1])
            sums[hit_doc[at]] += points[at]  # a text stands once in the list of a word
        at = np.flatnonzero(sums if ok is None else (sums > 0) & ok[q])
        if k is not None and len(at) > k:
            cut = np.partition(sums[at], len(at) - k)[len(at) - k]
            at = at[sums[at] >= cut]
            at = at[np.lexsort((order[at], -sums[at]))[:k]]
        took.append(at)
        scores.append(sums[at])
        question.append(np.full(len(at), q))
    at, q = np.concatenate(took), np.concatenate(question)
    return pa.RecordBatch.from_arrays([pa.array(ids[0][q]), pa.array(ids[1][q]), keys.take(pa.array(at)), pa.array(np.concatenate(scores))], names=["_h", "_g", key, "_s"])


#: Columns of a filter, each null where it asks for nothing, and those of a text that it is put to.
FILTER = ("slugs", "tipos", "desde", "hasta")
TEXT = ("slug", "tipo", "fecha_inicio", "fecha_fin")


def _asked_slug() -> Column:
    """Each slug of a filter, or null for a filter without."""
    return F.explode_outer(F.array_distinct("slugs")).alias("_s")


def _sized(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """rows with _b, their block among those of the same `by`: of about `most` rows, by hash of key."""
    size = rows.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / F.lit(most)).alias("_blocks"))
    return rows.join(size, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_b", F.pmod(F.xxhash64(key), "_blocks")).drop("_by", "_blocks")


def dated() -> Column:
    """Whether a text's days overlap those of a filter; days that are not known do."""
    return (F.col("desde").isNull() | F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= F.col("desde"))) & (F.col("hasta").isNull() | F.col("fecha_inicio").isNull() | (F.col("fecha_inicio") <= F.col("hasta")))


def accepts() -> Column:
    """Whether a row's text (TEXT) passes its filter (FILTER)."""
    among = lambda c, of: F.col(of).isNull() | F.coalesce(F.array_contains(of, F.col(c)), F.lit(False))
    return among("slug", "slugs") & among("tipo", "tipos") & dated()


def accepted(docs: DataFrame, gold: DataFrame, on: str) -> DataFrame:
    """Pairs of a case of a gold set and a text that it accepts: equal `on`, and, where the case asks for
    them, its kind (_tipo), a day that the text covers (_dia), and words that stand in it (_contiene)."""
    inside = F.contains(normalised("text"), normalised("_contiene"))
    tests = {"_tipo": F.col("tipo") == F.col("_tipo"), "_dia": (F.col("fecha_inicio") <= F.col("_dia")) & (F.col("fecha_fin") >= F.col("_dia")), "_contiene": inside}
    pairs = gold.join(docs, on)
    for c, test in tests.items():
        pairs = pairs.where(F.col(c).isNull() | test)
    return pairs


def _accepted(filters: dict[str, pa.Array], texts: dict[str, pa.Array]) -> np.ndarray:
    """`accepts` of queries and texts: a row for each query, a column for each text."""
    slugs, tipos, desde, hasta = (filters[c] for c in FILTER)
    slug, tipo, first, last = (texts[c] for c in TEXT)
    ok = np.ones((len(slugs), len(slug)), bool)
    for i in range(len(slugs)):
        for asked, held in ((slugs[i], slug), (tipos[i], tipo)):
            if asked.is_valid:
                ok[i] &= pc.is_in(held, value_set=asked.values.drop_null()).to_numpy(zero_copy_only=False)
        for bound, held, test in ((desde[i], last, pc.greater_equal), (hasta[i], first, pc.less_equal)):
            if bound.is_valid:
                ok[i] &= pc.fill_null(test(held, bound), True).to_numpy(zero_copy_only=False)
    return ok


def relaxed(asked: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """The questions with their filters; where a filter leaves no text, it asks for nothing."""
    kinds = docs.select(*TEXT).distinct()
    named = asked.where("slugs IS NOT NULL").select(query, *FILTER, F.explode("slugs").alias("slug")).join(kinds, "slug").where(accepts()).select(query)
    open_ones = asked.where("slugs IS NULL")
    # Of filters without product there are as many as kinds and dates; so there are of texts without theirs.
    filters = open_ones.select(*FILTER[1:]).distinct()
    days = kinds.select(*TEXT[1:]).distinct()
    live = filters.crossJoin(days).withColumns({"slugs": F.lit(None).cast("array<string>"), "slug": F.lit(None).cast("string")}).where(accepts()).select(*FILTER[1:]).distinct()
    same = [open_ones[c].eqNullSafe(live[c]) for c in FILTER[1:]]
    passing = named.unionByName(open_ones.join(live, same[0] & same[1] & same[2], "left_semi").select(query)).distinct().withColumn("_ok", F.lit(True))
    rows = asked.join(passing, query, "left")
    return rows.select(*[c for c in asked.columns if c not in FILTER], *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in FILTER])


def floor(asked: DataFrame, docs: DataFrame, query: str, key: str, budget: int = 14, periods: int = 4, odd: int = 3, days: int = 3) -> DataFrame:
    """query, key, rango: the texts that an answer rests on, whatever is found.

    asked: query, productos (slugs that it names, null for none), desde, hasta. The budget is shared
    by the products: of each its profile, latest periods and latest anomalies; if the question has
    dates, the periods within them first, then profile, other periods and anomalies. Without product,
    the latest market days, within the dates if there are any.
    """
    has_dates = F.col("desde").isNotNull() | F.col("hasta").isNotNull()
    kinds = F.array(*map(F.lit, ("producto_perfil", "producto_periodo", "evento_anomalia")))
    named = asked.where("productos IS NOT NULL").select(query, "desde", "hasta", F.explode("productos").alias("slug"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.size("productos"))).alias("_cupo"))
    texts = docs.where(F.array_contains(kinds, F.col("tipo"))).select(key, *TEXT)
    wanted = named.select("slug", "desde", "hasta").distinct()
    within = (F.col("tipo") == "producto_periodo") & has_dates & dated()
    group = F.when(within, 0).when(F.col("tipo") == "producto_perfil", 1).when(F.col("tipo") == "producto_periodo", 2).otherwise(3)
    own = Window.partitionBy("slug", "desde", "hasta")
    latest = [F.desc_nulls_last(F.when(F.col("_g") != 1, F.col("fecha_fin"))), key]
    picked = wanted.join(texts, "slug").withColumn("_g", group)
    picked = picked.withColumn("_n", F.row_number().over(Window.partitionBy("slug", "desde", "hasta", "_g").orderBy(*latest)))
    picked = picked.where(F.col("_n") <= F.when(F.col("_g") == 2, periods).when(F.col("_g") == 3, odd).otherwise(budget))
    picked = picked.withColumn("_p", F.row_number().over(own.orderBy("_g", "_n"))).where(F.col("_p") <= budget)
    picked = picked.select(F.col("slug").alias("_slug"), F.col("desde").alias("_a"), F.col("hasta").alias("_z"), key, "_p")
    held = named.join(picked, (F.col("slug") == F.col("_slug")) & F.col("desde").eqNullSafe(F.col("_a")) & F.col("hasta").eqNullSafe(F.col("_z"))).where("_p <= _cupo")
    of_products = held.select(query, key, F.row_number().over(Window.partitionBy(query).orderBy("slug", "_p")).alias("rango"))
    bare = asked.where("productos IS NULL").select(query, "desde", "hasta")
    market = bare.select("desde", "hasta").distinct().crossJoin(docs.where("tipo = 'mercado_dia'").select(key, *TEXT)).where(dated())
    market = market.withColumn("rango", F.row_number().over(Window.partitionBy("desde", "hasta").orderBy(F.desc_nulls_last("fecha_fin"), key))).where(F.col("rango") <= days).select(F.col("desde").alias("_a"), F.col("hasta").alias("_z"), key, "rango")
    of_days = bare.join(market, F.col("desde").eqNullSafe(F.col("_a")) & F.col("hasta").eqNullSafe(F.col("_z"))).select(query, key, "rango")
    return of_products.unionByName(of_days)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, asked: str, k: int = 10, block: int = 2048, step: float = 1e-5, filtered: bool = False) -> DataFrame:
    """query, key, coseno, rango: the k vectors of greatest inner product with each query vector, exactly.

    A stated query set against all rows, in blocks: both sides are packed into blocks of about `block`
    vectors, each two blocks are multiplied as matrices, and only the best k of a block for each query
    leave the task. coseno is the product in steps of `step`; ties go to the smaller key. Rows with a
    null key or vector are left out; lengths must agree. filtered: vectors have the columns of a text
    and queries those of a filter as in `accepts`, and only texts that a query's filter accepts count;
    a block of texts of one slug meets only the queries that ask for it or for none.
    """
    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)[query]

    def blocks(df: DataFrame, of: str, what: str, names: tuple[str, str, str], more: tuple[str, ...], slug: Column) -> DataFrame:
        rows = df.where(F.col(what).isNotNull() & F.col(of).isNotNull()).select(F.col(of), F.col(what).cast("array<double>").alias("_v"), *more)
        own = [names[0]] * filtered
        if filtered:
            rows = _sized(rows.select("*", slug.alias(names[0])), names[0], of, block)
        else:
            rows = rows.withColumn("_b", F.pmod(F.xxhash64(of), F.lit(max(1, -(-rows.count() // block)))))
        return rows.groupBy("_b", *own).agg(F.collect_list(F.struct(F.col(of).alias("i"), F.col("_v").alias("v"), *more)).alias(names[1])).select(*own, F.col(f"{names[1]}.i").alias(names[1]), F.flatten(f"{names[1]}.v").alias(names[2]), *[F.col(f"{names[1]}.{c}").alias(f"_{c}") for c in more])

    left = blocks(queries, query, asked, ("_s", "_q", "_qv"), FILTER if filtered else (), _asked_slug())
    right = blocks(vectors, key, vector, ("_of", "_k", "_kv"), TEXT if filtered else (), F.col("slug"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q, x = b.column("_q")[r].values, b.column("_k")[r].values
                qm = b.column("_qv")[r].values.to_numpy().reshape(len(q), -1)
                xm = b.column("_kv")[r].values.to_numpy().reshape(len(x), -1)
                s = np.rint(qm @ xm.T / step).astype(np.int64)
                ids = x.to_numpy()
                ok = _accepted(*({c: b.column(f"_{c}")[r].values for c in of} for of in (FILTER, TEXT))) if filtered else np.ones(s.shape, bool)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s, ~ok), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                at = np.flatnonzero(np.take_along_axis(ok, order, 1).ravel())
                yield pa.RecordBatch.from_arrays([q.take(pa.array(row[at])), x.take(pa.array(order.ravel()[at])), pa.array(np.take_along_axis(s, order, 1).ravel()[at])], names=[query, key, "_s"])

    pairs = left.repartition(F.xxhash64("_q")).crossJoin(right)
    pairs = pairs.where("_s IS NULL OR _s = _of") if filtered else pairs
    best = pairs.mapInArrow(score, f"{query} {kinds[1]}, {key} {kinds[0]}, _s bigint")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_s"), key))
    return best.withColumn("rango", rank).where(F.col("rango") <= k).select(query, key, F.col("_s").alias("coseno"), "rango")


def fused(lists: list[DataFrame], query: str, key: str, rank: str = "rango", c: int = 60, k: int = 10) -> DataFrame:
    """query, key, rrf, rango: reciprocal rank fusion, the sum of 1 / (c + rank) over the lists."""
    every = lists[0].select(query, key, rank)
    for other in lists[1:]:
        every = every.unionByName(other.select(query, key, rank))
    score = every.groupBy(query, key).agg(F.sum(F.floor(F.lit(1e12) / (c + F.col(rank)) + 0.5).cast("bigint")).alias("_s"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_s"), key))
    return score.withColumn("rango", place).where(F.col("rango") <= k).select(query, key, (F.col("_s") / 1e12).alias("rrf"), "rango")


def judged(ranked: DataFrame, relevant: DataFrame, query: str, key: str, k: int = 10) -> DataFrame:
    """query, recall, mrr: share of the relevant keys among the first k, and 1 / rank of the first one."""
    hits = ranked.where(F.col("rango") <= k).join(relevant.select(query, key).distinct(), [query, key])
    got = hits.groupBy(query).agg(F.count("*").alias("_h"), F.min("rango").alias("_r"))
    want = relevant.select(query, key).distinct().groupBy(query).agg(F.count("*").alias("_n"))
    return want.join(got, query, "left").select(query, (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("recall"), F.coalesce(1 / F.col("_r"), F.lit(0.0)).alias("mrr"))
