import datetime as dt
import itertools
import json

import numpy as np

from lonja.operators.drift import assignment, canonical_names, changes, drift, field_name, profile, unify

SCHEMA = "reporte_id bigint, fuente string, fecha date, contenido string, perfil string"


def delivered(i, source, day, rows):
    return (i, source, dt.date(2024, 1, 30) + dt.timedelta(day) if day is not None else None, json.dumps(rows) if isinstance(rows, list) else rows, "x")


def test_names():
    assert [field_name(x) for x in ("Masa Hoy", "MASA_HOY", "masa-hoy", "señal", " Precio  7D ", "")] == ["masa_hoy"] * 3 + ["senal", "precio_7d", ""]


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (3, 6)):
        c = rng.random((n, m))
        got = assignment(c)
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
        if n <= m:
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert np.isclose(sum(c[i, j] for i, j in got), best)


def between(a, b):
    return sorted(changes(profile(json.dumps(a)), profile(json.dumps(b))), key=str)


def test_kinds_of_change():
    old = [{"Producto": "Papa", "Masa": 1.5, "Precio": 2.0, "Ok": True}, {"Producto": "Yuca", "Masa": 2.5, "Precio": None, "Ok": None}]
    assert between(old, [{"OK": False, "MASA": 3, "precio": 2, "producto": "Ajo"}]) == []
    assert between(old, [{"Producto": "Papa", "Masa": "1,5", "Precio": 2.0, "Ok": True}]) == [("masa", "tipo", None)]
    assert between(old, [{"Producto": "Papa", "Volumen": 1.4, "Precio": 2.0, "Ok": True}]) == [("masa", "renombrado", "volumen")]
    assert between(old, [{"Producto": "Papa", "Masa": 1.5, "Precio": 2.0, "Ok": [True], "Lote": "L1"}]) == [("lote", "agregado", None), ("ok", "tipo", None)]
    assert between(old, [{"Masa": 1.5, "Precio": 2.0, "Ok": True, "Lote": "L1"}]) == [("lote", "agregado", None), ("producto", "retirado", None)]
    two = [{"Producto": "Papa", "A": 1.5, "B": 2.0, "Ok": True}]
    assert between(old, two) == [("masa", "renombrado", "a"), ("precio", "renombrado", "b")]


def test_order_within_rows_is_no_change():
    a = [{"p": "x", "a": 1, "b": 2}, {"b": 3, "p": "y", "a": 4}]
    b = [{"a": 1, "c": 5, "p": "x"}, {"p": "x", "a": 1, "c": 2}, {"p": "x", "a": 1, "c": 2}]
    assert between(a, b) == [("b", "renombrado", "c")]


def test_sequences_across_tiles_copies_and_nulls(spark):
    one, two = [{"p": "x", "a": 1}], [{"p": "x", "b": 1}]
    rows = [
        delivered(1, "s", 0, one),
        delivered(1, "s", 0, one),
        delivered(2, "s", 1, two),
        delivered(3, "s", 40, two),
        delivered(4, "s", 90, [{"p": "x"}]),
        delivered(5, "s", 91, [{"p": "x", "a": 2}]),
        delivered(6, "t", 2, two),
        delivered(7, "s", None, two),
        delivered(8, None, 3, one),
        delivered(9, "u", 1, None),
        delivered(10, "u", 2, "not json"),
        delivered(11, "u", 3, one),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = drift(df)
    got = sorted((r.reporte_id, r.campo, r.cambio) for r in found.collect())
    assert got == [(2, "a", "renombrado"), (4, "b", "retirado"), (5, "a", "agregado"), (11, "a", "agregado"), (11, "p", "agregado")]
    table = {(r.reporte_id, r.nombre): (r.campo, r.tipo, r.valor) for r in unify(df, found).collect()}
    assert table[3, "b"] == ("a", "numero", "1") and table[1, "a"] == ("a", "numero", "1") and table[6, "b"][0] == "b"
    assert table[7, "b"][0] == "b" and table[8, "p"] == ("p", "texto", "x")


def test_chains_of_renames_lead_to_the_first_name(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame([delivered(i, "s", i, [{"p": "x", n: 1.0}]) for i, n in enumerate(names)], SCHEMA)
    out = unify(df, drift(df)).where("nombre <> 'p'").collect()
    assert {r.campo for r in out} == {"a"} and {r.nombre for r in out} == set(names)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drift(df).count() == 0 and unify(df, drift(df)).count() == 0


def test_a_field_renamed_to_and_fro(spark):
    import time

    first = dt.date(2000, 1, 1)
    rows = [("f", first + dt.timedelta(i), "a" if i % 2 else "b", "renombrado", "b" if i % 2 else "a") for i in range(1, 1025)]
    found = spark.createDataFrame(rows, "fuente string, fecha date, campo string, cambio string, nuevo string")
    began = time.time()
    got = canonical_names(found).collect()
    assert len(got) == 1024 and {r.canonico for r in got} == {"a"} and time.time() - began < 60
