import random

import numpy as np
import pytest

from lonja.llm.spans import Rolling, classes, code_points, repeats, seeds, shared_spans, shares, sliding

SCHEMA = "doc_id bigint, text string, pos int, inicio string"


def brute(rows, length):
    have = {}
    for d, t in rows:
        if t is not None and d is not None:
            for i in range(len(t) - length + 1):
                have.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in rows:
        if t is None or d is None:
            continue
        spans = []
        for i in range(len(t) - length + 1):
            if len(have[t[i : i + length]]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out |= {(d, a, b) for a, b in spans}
    return out


def found(spark, rows, **k):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    return [(r.doc_id, r.inicio, r.fin) for r in shared_spans(df, **k).collect()]


def noise(rng, n, letters="abcdefgh ñé👩"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [noise(rng, rng.randint(10, 120)) for _ in range(6)]
    rows = []
    for d in range(25):
        t = "".join(rng.choice(pool) if rng.random() < 0.5 else noise(rng, rng.randint(0, 60)) for _ in range(rng.randint(0, 6)))
        rows.append((d, t))
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, None), (33, ""), (34, "ab" * 300), (35, "x" + "ab" * 100), (36, "a" * 500), (37, "a" * 61)]
    got = found(spark, rows, length=60, seed=30)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 60)


def test_exactly_the_length(spark):
    rng = random.Random(5)
    s = noise(rng, 200)
    rows = [(1, noise(rng, 50) + s + noise(rng, 50)), (2, s), (3, s[:199] + "#"), (4, "#" + s[1:])]
    assert sorted(found(spark, rows)) == [(1, 50, 250), (2, 0, 200)]


def test_very_long_texts(spark):
    rng = random.Random(8)
    s = noise(rng, 150_000, "abcdefgh \n")
    got = sorted(found(spark, [(1, s), (2, noise(rng, 69_999) + "#" + s[1000:140_000] + "#"), (3, " " * 100_000), (4, "x" + " " * 90_000)]))
    assert got == [(1, 1000, 140_000), (2, 70_000, 209_000), (3, 0, 100_000), (4, 1, 90_001)]


def test_within_one_document_is_no_case(spark):
    s = noise(random.Random(6), 300)
    assert found(spark, [(1, s + s), (1, s), (None, s), (2, None)]) == []
    assert found(spark, []) == []


def test_shares(spark):
    s = noise(random.Random(7), 250)
    df = spark.createDataFrame([(1, s, 1, "x"), (2, s + s[:50], 1, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (5, "corto", 1, "x")], SCHEMA)
    got = {r.doc_id: (r.caracteres, r.compartidos, r.parte) for r in shares(df, shared_spans(df)).collect()}
    assert got[1] == (250, 250, 1.0) and got[2][:2] == (300, 250) and got[3] == (0, 0, None) and got[4] == (0, 0, None) and got[5] == (5, 0, 0.0)


def test_windows_and_winnowing():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, 100).astype(np.uint64)
    assert sliding(x, 7, np.minimum).tolist() == [x[i : i + 7].min() for i in range(94)]
    t = code_points("abcabcabd" * 5)
    h = Rolling(0x9E3779B97F4A7C15).windows(t, 4)
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (t[i : i + 4].tolist() == t[j : j + 4].tolist())
    at = seeds(h, 5)
    for i in range(len(h) - 4):
        assert any(i <= p < i + 5 and h[p] == h[i : i + 5].min() for p in at)


def mixture(seed):
    rng = random.Random(seed)
    pool = [noise(rng, rng.randint(10, 120)) for _ in range(5)]
    rows = [(d, "".join(rng.choice(pool) if rng.random() < 0.6 else noise(rng, rng.randint(0, 60)) for _ in range(rng.randint(0, 6)))) for d in range(25)]
    formula = noise(rng, 40)  # a seed within ever other texts
    rows += [(100 + i, noise(rng, 40) + formula + noise(rng, 40)) for i in range(12)]
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (202, "ab" * 90), (203, "x" + "ab" * 50)]


@pytest.mark.parametrize("seed, most", [(0, 1), (1, 2), (2, 64)])
def test_seeds_with_many_surroundings(spark, seed, most):
    rows = mixture(seed)
    got = found(spark, rows, length=60, seed=30, most=most)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 60)


@pytest.mark.parametrize("seed, most", [(3, 64), (4, 2)])
def test_no_link_is_lost(spark, seed, most):
    rows = mixture(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    held = classes(repeats(df, length=60, seed=30, most=most)).collect()
    text = dict(rows)
    for r in held:
        assert text[r.doc_id][r.inicio : r.fin] == text[r.clase][r.clase_inicio : r.clase_inicio + r.fin - r.inicio]
        assert r.clase <= r.doc_id and r.veces >= 2 and r.fin - r.inicio >= 60
    windows = {}
    for d, t in rows:
        for i in range(len(t) - 59):
            windows.setdefault(t[i : i + 60], []).append((d, i))
    for places in windows.values():
        if len({d for d, _ in places}) < 2:
            continue
        maps = [{(r.clase, i - r.inicio + r.clase_inicio) for r in held if r.doc_id == d and r.inicio <= i and i + 60 <= r.fin} for d, i in places]
        assert set.intersection(*maps)
