import datetime as dt

from lonja.operators import windows
from lonja.plans.reference import VALUES, top_anomalies

D = dt.date(2024, 1, 1)


def test_masses_and_the_last_date(spark):
    rows = []
    for i in range(60):
        p, m = 1000 + i % 2, 500 + i % 3
        if i in (20, 25, 30, 35, 40, 45):
            p = 9000 + i
        if i == 59:
            p = 1060  # an anomaly, less than the five greatest
        rows.append((1, 1, D + dt.timedelta(i), p, 5000 if i == 50 else m))
    rows.append((2, 2, D + dt.timedelta(90), 10, 10))
    df = spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha date, p bigint, m bigint")
    hot = {(r.tipo, r.fecha): r for r in windows.anomalies(df, VALUES).collect()}
    day = lambda i: D + dt.timedelta(i)
    assert hot["volumen", day(50)].valor == 5000 and all(("precio", day(i)) in hot for i in (20, 25, 30, 35, 40, 45, 59))
    assert len({k for k in hot if k[0] == "volumen"}) == 1
    prices = {r.fecha: r.z for r in windows.robust_z(df, "p").where("abs(z) >= 3.5").collect()}
    assert prices == {f: r.z for (k, f), r in hot.items() if k == "precio"}
    got = {(r.tipo, r.fecha): r.rango for r in top_anomalies(df).collect()}
    assert got["volumen", day(50)] == 1
    # The sixth of the earlier ones is left out, the last date of the market is not.
    assert got["precio", day(59)] == 7 and sorted(got.values()) == [1, 1, 2, 3, 4, 5, 7]
