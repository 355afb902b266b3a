import datetime as dt

import numpy as np

from lonja.operators.rolling import rolling, trailing_sums

SCHEMA = "producto_id int, mercado_id int, fecha date, m double, p double, con_fila string, r double"


def brute(rows, windows):
    by = {}
    for r in rows:
        if None not in r[:3]:
            by.setdefault(r[:2], {})[r[2]] = r
    out = {}
    for k, days in by.items():
        d, last = min(days), max(days)
        while d <= last:
            for w in windows:
                seen = [days[x] for x in (d - dt.timedelta(i) for i in range(w)) if x in days]
                ms = [r[3] for r in seen if r[3] is not None and r[3] == r[3]]
                ps = [r[4] for r in seen if r[4] is not None and r[4] == r[4]]
                out[(*k, d, w)] = (sum(ms), sum(ms) / w, len(ms), sum(ps) / len(ps) if ps else None)
            d += dt.timedelta(1)
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(5):
        day = dt.date(2024, 1, 1) + dt.timedelta(int(rng.integers(50)))
        for _ in range(int(rng.integers(1, 90))):
            v = lambda: [None, float("nan"), round(float(rng.uniform(0, 9)), 2), round(float(rng.uniform(0, 9)), 2)][rng.integers(4)]
            rows.append((s, 1, day, v(), v(), "x", 1.0))
            day += dt.timedelta(int(rng.integers(1, 40 if rng.random() < 0.1 else 4)))
    rows += [(None, 1, dt.date(2024, 1, 1), 1.0, 1.0, "x", 1.0), (1, 1, None, 1.0, 1.0, "x", 1.0)]
    got = rolling(spark.createDataFrame(rows, SCHEMA), ["m"], ["p"], carry=["r"], tile=16).collect()
    want = brute(rows, (7, 30))
    assert len(got) * 2 == len(want)
    for r in got:
        for w in (7, 30):
            total, mean, n, p = want[r.producto_id, r.mercado_id, r.fecha, w]
            assert abs(r[f"m_total_{w}"] - total) < 1e-9 and abs(r[f"m_media_{w}"] - mean) < 1e-9 and r[f"m_n_{w}"] == n
            assert (r[f"p_media_{w}"] is None) == (p is None) and (p is None or abs(r[f"p_media_{w}"] - p) < 1e-9)
        assert (r.r is None) == (r.con_fila == 0)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling(empty, ["m"], ["p"]).count() == 0
    one = rolling(spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), 2.0, None, "x", None)], SCHEMA), ["m"], ["p"]).collect()
    assert len(one) == 1 and one[0].m_total_30 == 2.0 and one[0].p_media_7 is None and one[0].dias == 0


def test_a_long_gap_crosses_tiles():
    day = np.array([0, 200])
    _, days, source, sums = trailing_sums(day, np.zeros(2, int), {"v": np.array([1.0, 2.0])}, (7, 30), tile=16)
    assert len(days) == 201 and (source >= 0).sum() == 2
    assert sums["v", 30][:30].tolist() == [1.0] * 30 and sums["v", 30][30:200].sum() == 0 and sums["v", 7][200] == 2
