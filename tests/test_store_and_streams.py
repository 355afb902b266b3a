import datetime as dt
import json

import pytest

from lonja.functions.calendar import calendar, easter, holidays, long_date_of
from lonja.sources import store
from lonja.streaming import prices

D = dt.date(2024, 1, 30)
SCHEMA = "k int, fecha date, v double, at timestamp"


def row(k, day, v, hour):
    return (k, D + dt.timedelta(day), v, dt.datetime(2024, 2, 1, hour))


def test_upserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([row(1, 0, 1.0, 1), row(1, 5, 2.0, 1), row(2, 0, 3.0, 1)], SCHEMA)
    later = spark.createDataFrame([row(1, 0, 9.0, 3), row(2, 0, 8.0, 0), row(3, 5, 7.0, 2)], SCHEMA)
    want = [(1, D, 9.0), (1, D + dt.timedelta(5), 2.0), (2, D, 3.0), (3, D + dt.timedelta(5), 7.0)]
    for batch in (first, later, later, first):
        store.upsert(spark, path, batch, ["k", "fecha"], "at", "fecha")
    got = sorted((r.k, r.fecha, r.v) for r in spark.read.parquet(path).collect())
    assert got == want and store.exists(spark, path) and not store.exists(spark, path + "x")


def test_streamed_upserts(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([row(1, 0, 1.0, 1), row(1, 0, 2.0, 2)], SCHEMA).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        prices.upserted(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k", "fecha"], "at", "fecha").awaitTermination()
        assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2.0)]
        spark.createDataFrame([row(1, 0, 1.5, 1)], SCHEMA).write.mode("append").parquet(str(source))


def test_streams_drop_copies_and_score(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 10.0 + i % 3 if i < 20 else 90.0) for i in range(21)] + [("b", dt.datetime(2024, 1, 1), None)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "u string, ts timestamp, v double").coalesce(1).write.parquet(path)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    stream = spark.readStream.schema("u string, ts timestamp, v double").parquet(path)
    scored = run(prices.scored(stream, "u", "ts", "v"), "scored")
    assert len(scored) == 21 and [r.v for r in scored if r.z is not None and r.z > 20] == [90.0]
    assert sum(r.z is None for r in scored) == 6
    assert len(run(prices.once_each(stream, ["u"], "ts"), "once")) == 2
    hours = run(prices.windows(stream, "ts", ["u"], "v", "2 hours"), "hours", "complete")
    assert sum(r.n for r in hours) == 22
    runs = run(prices.sessions(stream, "ts", ["u"], "90 minutes"), "sessions", "append")
    assert all(r.n >= 1 for r in runs)


def test_intake_and_exports(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    found = {r.path.rsplit("/", 1)[1]: r for r in store.files(spark, str(tmp_path), pattern="*.pdf").collect()}
    assert found["a.pdf"].valido and not found["b.pdf"].valido and found["a.pdf"].bytes == 10 and len(found["a.pdf"].sha256) == 64
    pages = spark.createDataFrame([(1, "<a href='/m/2'><a href='/m/1'>"), (2, "<a href='/m/1'><a href='/m/3'>"), (3, None)], "hoja int, html string")
    assert [r.enlace for r in store.links(pages, "html", "/m/[0-9]+", ["hoja"]).collect()] == ["/m/2", "/m/1", "/m/3"]
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, t string").coalesce(1)
    store.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(r.t or "" for r in back.collect()) == ["", 'a "b", c']
    store.write_documents(df, str(tmp_path / "json"))
    assert sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()), key=lambda x: x["i"]) == [{"i": 1, "t": 'a "b", c'}, {"i": 2}]


def test_calendar(spark):
    assert [easter(y) for y in (2024, 2025, 2026, 2019)] == [dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2026, 4, 5), dt.date(2019, 4, 21)]
    days = {r.fecha: r for r in calendar(spark, 2024, 2024).collect()}
    assert len(days) == 366 and days[dt.date(2024, 3, 29)].feriado and not days[dt.date(2024, 3, 29)].habil
    assert days[dt.date(2024, 3, 27)].hasta_feriado == 1 and days[dt.date(2024, 3, 30)].hasta_feriado == 30
    assert dt.date(2026, 7, 28) in holidays(2026, 2026)
    texts = [("Lima, 22 de junio de 2026", dt.date(2026, 6, 22)), ("1 Setiembre del 2025", dt.date(2025, 9, 1)), ("3 septiembre 2025", dt.date(2025, 9, 3)), ("31 de febrero de 2024", None), ("nada", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r.f for r in df.select("i", long_date_of("t").alias("f")).orderBy("i").collect()] == [f for _, f in texts]


@pytest.mark.parametrize("held, v, z", [([1, 1, 1, 1], 1, None), ([1, 1, 1, 1], 2, 99.0), ([1, 1, 1, 5], 5, (5 - 1) / (3**0.5))])
def test_score(held, v, z):
    assert prices.score(held, v) == pytest.approx(z) if z is not None else prices.score(held, v) is None


def test_upserts_keep_null_dates_and_move_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame([(k, f, v, dt.datetime(2024, 2, 1, h)) for k, f, v, h in rows], SCHEMA)
    january, march = dt.date(2024, 1, 30), dt.date(2024, 3, 2)
    got = lambda: sorted((r.k, r.fecha, r.v) for r in spark.read.parquet(path).collect())
    store.upsert(spark, path, make((1, None, 1.0, 1), (2, january, 2.0, 1)), ["k"], "at", "fecha")
    store.upsert(spark, path, make((3, None, 3.0, 2)), ["k"], "at", "fecha")
    assert got() == [(1, None, 1.0), (2, january, 2.0), (3, None, 3.0)]
    store.upsert(spark, path, make((2, march, 4.0, 3)), ["k"], "at", "fecha")  # empties January
    store.upsert(spark, path, make((1, march, 5.0, 4), (2, january, 2.0, 1)), ["k"], "at", "fecha")
    assert got() == [(1, march, 5.0), (2, march, 4.0), (3, None, 3.0)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "t__log"]


def test_compare_and_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.state(spark, path) == (0, None)
    assert store.swap(spark, path, 0, {"a": 1}) == 1 and store.state(spark, path) == (1, {"a": 1})
    with pytest.raises(store.Conflict):
        store.swap(spark, path, 0, {"a": 2})
    assert store.swap(spark, path, 1, {"a": 2}) == 2 and store.state(spark, path) == (2, {"a": 2})


def test_a_run_that_ended_midway_is_finished(spark, tmp_path):
    path, staged = str(tmp_path / "t"), str(tmp_path / "s")
    store.upsert(spark, path, spark.createDataFrame([row(1, 0, 1.0, 1)], SCHEMA), ["k", "fecha"], "at", "fecha")
    spark.createDataFrame([row(1, 0, 9.0, 2)], SCHEMA).selectExpr("*", "'2024-01' mes").write.partitionBy("mes").parquet(staged)
    store.swap(spark, path, 1, {"staged": staged, "emptied": []})
    with pytest.raises(store.Conflict):
        store.upsert(spark, path, spark.createDataFrame([row(2, 0, 1.0, 1)], SCHEMA), ["k", "fecha"], "at", "fecha")
    store.finish(spark, path)
    store.upsert(spark, path, spark.createDataFrame([row(2, 0, 1.0, 1)], SCHEMA), ["k", "fecha"], "at", "fecha")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 9.0), (2, 1.0)]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from lonja import session

    for master, fine in (("spark://host:7077", False), ("local-cluster[2,1,1024]", False), ("yarn", False), ("local[4]", True), ("local", True)):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(applicationId=master, master=master), conf=SimpleNamespace(get=lambda *_: None))
        if fine:
            assert session.shared_folder(fake).startswith("file://")
        else:
            with pytest.raises(ValueError):
                session.shared_folder(fake)
        session._SHARED.pop(master, None)
