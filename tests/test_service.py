import pytest

from lonja.service import Ambiguous, Service, span
from oracle import DATA


@pytest.fixture
def service(spark):
    return Service(spark, DATA)


def test_names(service):
    names = {r.id: r for r in service.products().collect()}
    assert len(names) == 135
    some = names[min(names)]
    assert service.product(some.slug) == some.id and service.product(some.nombre.upper()) == some.id
    with pytest.raises(Ambiguous) as e:
        service.product("papa")
    assert len(e.value.options) > 1
    with pytest.raises(Ambiguous):
        service.product("qwerty")
    assert {r.nombre.split()[0] for r in service.products("AJI ").collect()} == {"Ají"}


def test_reads(service):
    cover = service.coverage().first()
    assert cover.filas > 0 and cover.desde < cover.hasta
    name = service.prices().groupBy("producto_id").count().orderBy("count", ascending=False).first().producto_id
    slug = service.products().where(f"id = {name}").first().slug
    rows = service.series(slug).collect()
    assert rows and [r.fecha for r in rows] == sorted(r.fecha for r in rows)
    part = service.series(slug, "2024-06-01", "2024-06-30").collect()
    assert all(str(r.fecha).startswith("2024-06") for r in part)
    assert service.current(slug).first().p == [r.p for r in rows if r.p is not None][-1]
    table = service.compare([slug], 5).first()
    assert table.n == 5 and table.minimo <= table.ultimo <= table.maximo
    assert service.forecast(slug).first().mae > 0
    assert service.markets().count() > 0 and service.anomalies(3).count() <= 3
    assert service.day().first().masa > 0


def test_spans():
    assert span(None, "") == (None, None)
    with pytest.raises(ValueError):
        span("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        span("ayer", None)
