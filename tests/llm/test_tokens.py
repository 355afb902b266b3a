import random

import pytest

from lonja.llm.tokens import FOLDER, decoded, token_counts, token_ids

TEXTS = [
    "Papa Dorada · S/ 3.50/kg\r\n  fin\n\n",
    "<|endoftext|> it's 'quoted' we're I'll  ",
    "   ",
    "\n\t   x",
    "café Ñandú 北京 👩‍🌾 ﻿​ ½ ٣٤",
    "a" * 20_000,
    "ab " * 20_000,
    " ".join(random.Random(0).choice(["la", "papa", "12.5", "\n", "—"]) for _ in range(5_000)),
    "\x00\x1c\x1d\x85  x",
    "",
    None,
]
SCHEMA = "doc_id bigint, text string, ids string, pos int, word string"


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def test_same_as_the_tokenizer(spark, tokenizer):
    df = docs(spark, enumerate(TEXTS))
    got = {r.doc_id: r.ids for r in token_ids(df).collect()}
    assert got == {i: tokenizer(t) for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_round_trip(spark):
    df = docs(spark, enumerate(TEXTS))
    got = {r.doc_id: r.text for r in decoded(token_ids(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("share", [2.0, 0.02, 1e-4])
def test_frequent_and_rare_words_alike(spark, tokenizer, monkeypatch, share):
    from lonja.llm import tokens

    monkeypatch.setattr(tokens, "SHARE", share)
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcñ12 .\n") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, "".join(rng.choice(vocabulary[: 60 if i % 2 else 3]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    df = docs(spark, rows)
    got = {r.doc_id: r.ids for r in token_ids(df).collect()}
    assert got == {i: tokenizer(t) for i, t in rows}
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()} == {i: len(v) for i, v in got.items()}


def test_repeated_rows_null_keys_and_empty_tables(spark, tokenizer):
    df = docs(spark, [(1, "hola hola"), (1, "hola hola"), (2, ""), (2, ""), (3, None), (None, "uno dos"), (None, "tres")])
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df).collect()), key=str)
    want = [(1, tokenizer("hola hola"))] * 2 + [(2, []), (2, []), (3, []), (None, tokenizer("uno dos")), (None, tokenizer("tres"))]
    assert got == sorted(want, key=str)
    assert sorted((str(r.doc_id), r.tokens) for r in token_counts(df).collect()) == sorted((str(k), len(v)) for k, v in want)
    assert token_ids(df.limit(0)).count() == 0 and token_counts(df.limit(0)).count() == 0 and decoded(token_ids(df.limit(0))).count() == 0


def test_long_frequent_words_are_spread(spark, tokenizer):
    rows = [(i, "=" * 90 + " una " + "-" * (70 + i % 5)) for i in range(60)]
    df = docs(spark, rows)
    assert {r.doc_id: r.ids for r in token_ids(df).collect()} == {i: tokenizer(t) for i, t in rows}
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()} == {i: len(tokenizer(t)) for i, t in rows}
