import datetime as dt
import random

import pyarrow as pa

from lonja.operators import retrieval
from lonja.service import hybrid

D = dt.date


def test_questions_are_read(spark):
    kinds, docs = {"perfil": "producto_perfil", "periodo": "producto_periodo", "anomalia": "evento_anomalia", "dia": "mercado_dia"}, []

    def add(slug, kind, day, text):
        docs.append((len(docs), text, slug, kinds[kind], day, day))

    for name in ("papa", "yuca"):
        add(name, "perfil", D(2024, 6, 30), f"{name} perfil")
        for m in range(1, 7):
            add(name, "periodo", D(2024, m, 10), f"{name} en el mercado")
    for m in range(1, 6):
        add("papa", "anomalia", D(2024, m, 20), "papa anomalia")
        add(None, "dia", D(2024, m, 25), "resumen del mercado papa yuca")
    texts = spark.createDataFrame(docs, "doc_id bigint, text string, slug string, tipo string, fecha_inicio date, fecha_fin date")
    names = spark.createDataFrame([("papa", "Papa"), ("yuca", "Yuca")], "slug string, nombre string")
    asked = ["papa en febrero de 2024", "papa y yuca", "salto raro de la papa", "yuca raro en 2024-03-10", "resumen de marzo de 2024", "yuca raro el 2020-01-01"]
    questions = spark.createDataFrame(list(enumerate(asked)), "pregunta int, texto string")
    last = spark.createDataFrame([(D(2024, 6, 30),)], "ultima date")
    got = {}
    for r in sorted(hybrid(texts, names, questions, last).collect(), key=lambda r: r.rango):
        got.setdefault((r.pregunta, r.via), []).append(docs[r.doc_id])
    found = lambda q, via: [(x[2], x[3], x[5].month) for x in got.get((q, via), [])]
    # Dates: the period within them comes first, and nothing else is searched.
    assert found(0, "piso") == [("papa", kinds["periodo"], 2), ("papa", kinds["perfil"], 6)] + [("papa", kinds["periodo"], m) for m in (6, 5, 4, 3)] + [("papa", kinds["anomalia"], m) for m in (5, 4, 3)]
    assert found(0, "busqueda") == [("papa", kinds["anomalia"], 2)]
    # Two products share the floor of 14; each has fewer than seven or is cut to seven.
    assert [x[0] for x in found(1, "piso")] == ["papa"] * 7 + ["yuca"] * 5
    assert {x[0] for x in found(1, "busqueda")} <= {"papa", "yuca"}
    # Kinds narrow the search.
    assert {x[1] for x in found(2, "busqueda")} <= {kinds["anomalia"], kinds["periodo"]} and {x[0] for x in found(2, "busqueda")} == {"papa"}
    assert found(3, "piso")[0] == ("yuca", kinds["periodo"], 3)
    # Without product: market days within the dates.
    assert found(4, "piso") == [(None, kinds["dia"], 3)]
    # A filter that leaves nothing is opened, and its dates are dropped from the floor.
    assert found(5, "piso")[0] == ("yuca", kinds["perfil"], 6) and len(found(5, "busqueda")) > 0


def test_filters_hold_where_the_texts_lie(spark):
    """The same texts as of all pairs that share a word, filtered afterwards; and no more than k of a block leave it."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    day = lambda: rng.choice([None, D(2024, rng.randint(1, 6), 10)])
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=9)), rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"]), day(), day()) for i in range(400)], "doc_id bigint, text string, slug string, tipo string, fecha_inicio date, fecha_fin date")
    asked = [(i, " ".join(rng.choices(words, k=2)), rng.choice([None, ["a"], ["a", "c", "c"], ["d"]]), rng.choice([None, ["x"], ["x", "y"]]), day(), day()) for i in range(80)]
    asked.append((80, asked[0][1], None, None, None, D(2024, 3, 1)))
    asked.append((81, asked[0][1], None, None, D(2024, 3, 1), None))
    queries = spark.createDataFrame(asked, "pregunta int, texto string, slugs array<string>, tipos array<string>, desde date, hasta date")
    within = lambda hits: hits.join(queries.select("pregunta", *retrieval.FILTER), "pregunta").join(docs.drop("text"), "doc_id").where(retrieval.accepts()).select(*hits.columns)
    plain = retrieval.bm25(docs, queries, "doc_id", "text", "pregunta", "texto", 5, allowed=within)
    got = retrieval.bm25(docs, queries, "doc_id", "text", "pregunta", "texto", 5, filtered=True, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 200
    words_of = {"_h": [1], "_g": [1], "token": ["w1"], "_idf": [1.0], "_mean": [9.0], "slugs": [["a"]], "tipos": [None], "desde": [None], "hasta": [None], "_d": list(range(90)), "_t": [["w1"]] * 90, "slug": ["a", "b", None] * 30, "tipo": ["x"] * 90, "fecha_inicio": [None] * 90, "fecha_fin": [None] * 90}
    kinds = {"desde": pa.date32(), "hasta": pa.date32(), "fecha_inicio": pa.date32(), "fecha_fin": pa.date32(), "tipos": pa.list_(pa.string())}
    best = retrieval._best({c: pa.array(v, kinds.get(c)) for c, v in words_of.items()}, "doc_id", 5)
    assert best.column("doc_id").to_pylist() == [0, 3, 6, 9, 12]
