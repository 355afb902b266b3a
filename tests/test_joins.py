import datetime as dt
import random

import numpy as np

from lonja.operators.joins import asof, correlations, within
from lonja.operators.retrieval import bm25, fused, judged, nearest
from lonja.operators.skew import join_counted

D = dt.date(2024, 1, 1)


def test_asof_against_brute_force(spark):
    rng = random.Random(0)
    left = [(rng.choice([1, 2, 3, None]), D + dt.timedelta(rng.randint(0, 300)) if rng.random() < 0.95 else None, i) for i in range(200)]
    right = [(rng.choice([1, 2, 4]), D + dt.timedelta(rng.randint(0, 300)), rng.randint(0, 9)) for _ in range(60)]
    l = spark.createDataFrame(left, "k int, fecha date, i int")
    r = spark.createDataFrame(right, "k int, fecha date, v int")
    for strict in (False, True):
        got = {x.i: (x.fecha_asof, x.v_asof) for x in asof(l, r, ["k"], "fecha", ["v"], strict).collect()}
        assert len(got) == 200
        for k, f, i in left:
            seen = [(g, v) for q, g, v in right if k is not None and f is not None and q == k and (g < f or (g == f and not strict))]
            assert got[i] == (max(seen) if seen else (None, None))
    assert asof(l.limit(0), r, ["k"], "fecha", ["v"]).count() == 0 and asof(l, r.limit(0), ["k"], "fecha", ["v"]).where("v_asof IS NOT NULL").count() == 0


def test_within_against_brute_force(spark):
    rng = random.Random(1)
    points = [(rng.choice([1, 2, None]), D + dt.timedelta(rng.randint(0, 120)), i) for i in range(100)]
    spans = [(rng.choice([1, 2]), D + dt.timedelta(a), D + dt.timedelta(a + rng.randint(-3, 70)), i) for i, a in enumerate(rng.choices(range(100), k=40))] + [(1, None, D, 99)]
    got = within(spark.createDataFrame(points, "k int, f date, i int"), spark.createDataFrame(spans, "k int, a date, b date, j int"), ["k"], "f", "a", "b")
    want = {(i, j) for k, f, i in points for q, a, b, j in spans if k == q and a is not None and a <= f <= b}
    rows = [(r.i, r.j) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for day in range(100):
        base = int(rng.integers(-50, 50))
        for who in range(5):
            if rng.random() < 0.8:
                rows.append((1, D + dt.timedelta(day), who, base * (who % 3) + int(rng.integers(-20, 20))))
    df = spark.createDataFrame([*rows, (1, None, 1, 1), (1, D, None, 1), (2, D, 1, 5)], "g int, f date, w int, v bigint")
    got = {(r.a, r.b): (r.n, r.r) for r in correlations(df, "g", "f", "w", "v", 10).collect()}
    by = {(f, w): v for _, f, w, v in rows}
    for a in range(5):
        for b in range(a + 1, 5):
            both = [(by[f, a], by[f, b]) for f in {f for f, _ in by} if (f, a) in by and (f, b) in by]
            assert got[a, b][0] == len(both) and np.isclose(got[a, b][1], np.corrcoef(np.array(both).T)[0, 1])


def test_frequent_and_rare_keys_join_alike(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, v int")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", table_x())
    for share in (0.0, 0.2, 2.0):
        out = join_counted(rows, table, ["k"], share=share)
        assert out.columns == ["k", "v", "x"] and out.count() == 300 and out.where("x <> -k").count() == 0


def table_x():
    from pyspark.sql import functions as F

    return -F.col("k")


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(99, None)], "i int, v array<double>")
    asked = df.where("i % 5 = 0").toDF("q", "w")
    got = {}
    for r in nearest(df, asked, "i", "v", "q", "w", k=4, block=16).collect():
        got.setdefault(r.q, {})[r.rango] = (r.i, r.coseno)
    assert sorted(got) == list(range(0, 60, 5))
    for q, near in got.items():
        s = np.rint(v[q] @ v.T / 1e-5).astype(int)
        assert [near[k] for k in (1, 2, 3, 4)] == sorted(zip(range(60), s), key=lambda x: (-x[1], x[0]))[:4]


def test_bm25_prefers_rare_words_and_fusion_adds_up(spark):
    docs = spark.createDataFrame([(1, "papa papa yuca"), (2, "papa"), (3, "Papá camote"), (4, None), (5, "")], "i int, t string")
    asked = spark.createDataFrame([(10, "yuca papa"), (11, "nada"), (12, None)], "q int, t string")
    got = [(r.q, r.i, r.rango) for r in bm25(docs, asked, "i", "t", "q", "t").collect()]
    assert (10, 1, 1) in got and {x[0] for x in got} == {10}
    one = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q int, i int, rango int")
    two = spark.createDataFrame([(1, 6, 1)], "q int, i int, rango int")
    out = {r.i: (r.rango, r.rrf) for r in fused([one, two], "q", "i").collect()}
    assert out[6][0] == 1 and abs(out[6][1] - (1 / 62 + 1 / 61)) < 1e-9 and out[5][0] == 2
    relevant = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "q int, i int")
    scores = {r.q: (r.recall, r.mrr) for r in judged(fused([one, two], "q", "i"), relevant, "q", "i").collect()}
    assert scores == {1: (0.5, 0.5), 2: (0.0, 0.0)}
