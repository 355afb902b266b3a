import itertools
import time

import pytest

from lonja.llm.canonical import Automaton, Reference, Trie, allowed, edits, letters_in, map_names, walk
from lonja.llm.queries import REGIONAL

NAMES = ["Papa Dorada", "Papaya Lanceta", "Palta Frontina", "Papa Frontina", "Yuca Ibérica", "Maíz Choclo Tarmina", "Plátano Tarmina", "Fresa", "Poro", "Culantro", "Mango Tronquito", "Mandarina Tronquito", "Cebolla Azabache", "Vainita Bermeja", "Coliflor", "Haba Índiga"]
REF = Reference(list(enumerate(NAMES)), REGIONAL)


@pytest.mark.parametrize(
    "text, name",
    [
        ("papa dorada", "Papa Dorada"),
        ("  YUCA IBERICA 1/", "Yuca Ibérica"),
        ("Y u c a   I b é r i c a", "Yuca Ibérica"),
        ("3/ Yuca-Ibérica*", "Yuca Ibérica"),
        ("Ibérica Yuca", "Yuca Ibérica"),
        ("YucaIberica (de 1ra)", "Yuca Ibérica"),
        ("Yu ca Ibérica", "Yuca Ibérica"),
        ("Yuca (Ibérica) (selva)", "Yuca Ibérica"),
        ("Yca Ibreica", "Yuca Ibérica"),
        ("mandioca tipo ibérica", "Yuca Ibérica"),
        ("Elote Tarmina", "Maíz Choclo Tarmina"),
        ("Maíz Choclos Tarm.", "Maíz Choclo Tarmina"),
        ("Banano Tarmina:", "Plátano Tarmina"),
        ("Papa. Lanceta", "Papaya Lanceta"),
        ("Pata Frontina", "Palta Frontina"),
        ("Cebo. Azabache", "Cebolla Azabache"),
        ("Ceb0lla Azabache", "Cebolla Azabache"),
        ("Vainita Berrneja", "Vainita Bermeja"),
        ("Frutilla", "Fresa"),
        ("Fre.", "Fresa"),
        ("poor", "Poro"),
        ("CILANTRO", "Culantro"),
        ("Coliflores", "Coliflor"),
    ],
)
def test_meant(text, name):
    assert [NAMES[m.entry] for m in REF.matches(text)] == [name]


@pytest.mark.parametrize("text", [None, "", "  ", "-", "s/n", "Papa", "Papa Lanceta", "Yuca Dorada", "Papa Ocraña", "Total general", "Lenguado", "Naranja Azabache", "papa" * 3000, "(", "...", "1/"])
def test_unmatched(text):
    assert REF.matches(text) == []


def test_both_of_two_equally_near():
    assert sorted(NAMES[m.entry] for m in REF.matches("Man. Tronquito")) == ["Mandarina Tronquito", "Mango Tronquito"]


def test_automaton_against_dynamic_programme():
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("ab", repeat=n)] + ["abcab", "bacab"]
    trie = Trie((w, i) for i, w in enumerate(words))
    for query in ("a", "abba", "babab", "abcba"):
        for errors in (0, 1, 2):
            a = Automaton(query, errors)
            got = {}
            for i, s in walk(trie, a, a.start):
                d = a.distance(s)
                if d is not None:
                    got[words[i]] = d
            assert got == {w: edits(query, w) for w in words if edits(query, w) <= errors}


def test_allowed_errors_grow_with_length():
    assert [allowed(n) for n in (1, 3, 5, 6, 12, 13)] == [0, 1, 1, 2, 2, 3]


def test_table(spark):
    reference = spark.createDataFrame([(i, n, 1.0 + i, "Kilogramo") for i, n in enumerate(NAMES)] + [(99, None, 0.0, None)], "id int, nombre string, equiv_kg double, unidad string")
    rows = [(1, "Yuca Iberica", None, "x"), (2, None, 1.0, "x"), (3, "Man. Tronquito", 11.0, "x"), (4, "Man. Tronquito", None, "x"), (5, "Man. Tronquito", 50.0, "x"), (1, "Yuca Iberica", None, "x")]
    df = spark.createDataFrame(rows, "fila int, texto string, equiv_kg double, entrada string")
    out = map_names(df, "texto", reference, ("id", "nombre"), REGIONAL, {"equiv_kg": "equiv_kg"}).collect()
    got = sorted((r.fila, r.entrada, len(r.candidatos)) for r in out)
    assert got == [(1, 4, 1), (1, 4, 1), (2, None, 0), (3, 10, 2), (4, None, 2), (5, None, 2)]
    assert map_names(df.limit(0), "texto", reference, ("id", "nombre")).count() == 0
    assert map_names(df, "texto", reference.limit(0), ("id", "nombre")).where("entrada IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        map_names(df, "texto", reference, ("id", "nombre"), most_entries=3)


def test_all_within_the_distance_as_in_the_plain_search():
    texts = ["Papa Dorada", "Pata Frontina", "Papa Frontnia", "poor", "Frse", "Man. Tronquito", "Maíz Choclos Tarm.", "Hba Indiga", "Yuca", "mandarina trnquito", "x" * 80 + " papa", "", None]
    found = REF.search(texts)
    for text, (near, within) in zip(texts, found):
        want = {}
        for q in REF.queries(text):
            a = Automaton(q, allowed(letters_in(q)))
            for label, s in walk(REF.walks.trie, a, a.start):
                d = a.distance(s)
                if d is not None:
                    for i in REF.ids[REF.pairs[label]]:
                        want[i] = min(d, want.get(i, d))
        assert {m.entry: m.distance for m in within} == want
        assert {m.entry for m in near} <= set(want) and [m.distance for m in within] == sorted(m.distance for m in within)
    assert {NAMES[m.entry] for m in found[1][1]} == {"Palta Frontina", "Papa Frontina"}


def test_abbreviations_are_completed_within_the_walk():
    ref = Reference([(i, f"{a} {b}") for i, (a, b) in enumerate(itertools.product(["Papa", "Palta", "Coliflor", "Maca", "Cebolla"], ["Criolla", "Amarilla", "Serrana"]))])
    names = dict(ref.entries)
    assert {names[m.entry] for m in ref.matches("P. Cri.")} == {"Papa Criolla", "Palta Criolla"}
    assert [names[m.entry] for m in ref.matches("Ceb. S.")] == ["Cebolla Serrana"]
    assert [names[m.entry] for m in ref.matches("Cebi. Serrana")] == ["Cebolla Serrana"]  # a slip in the beginning
    began = time.time()
    for text in ("p. c. m.", "p. c. m. a. s.", "p. c. m. a. s. c. p. m. a."):
        assert ref.matches(text) == []
    assert time.time() - began < 0.5


def test_frequent_long_and_null_names(spark):
    reference = spark.createDataFrame([(1, "Yuca Ibérica"), (2, "Fresa")], "id bigint, nombre string")
    rows = [("Fresa",)] * 300 + [("yuca iberca",), (None,), ("",), ("fresa (" + "muy rica " * 60 + ")",), ("z" * 400,)]
    df = spark.createDataFrame(rows, "t string")
    got = map_names(df, "t", reference, ("id", "nombre")).collect()
    assert len(got) == len(rows) and sum(r.entrada == 2 for r in got) == 301 and sum(r.entrada == 1 for r in got) == 1
    assert [[tuple(x) for x in r.dentro] for r in got if r.t == "yuca iberca"] == [[(1, 1)]]
