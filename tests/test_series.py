import numpy as np

from lonja.operators.series import Block, holding_rows, map_series


def test_last_write_holds(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (1, None, "y"), (2, None, "q"), (None, 1, "n"), (None, 2, "m"), (3, 1, None), (3, 1, "c"), (3, 1, "c")]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    got = {(r.k, r.at, r.v) for r in holding_rows(df, ["k"], "at", ["v", "at"]).collect()}
    assert got == {(1, 5, "b"), (2, None, "q"), (None, 2, "m"), (3, 1, "c")}
    assert holding_rows(df.limit(0), ["k"], "at", ["v"]).count() == 0


def test_series_stay_whole_whatever_the_block_size(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(20)), 1, int(i)) for i in range(3000)] + [(99, 1, int(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "producto_id int, mercado_id int, fecha int")

    def kernel(b: Block):
        assert all((np.diff(b["fecha"][s:e]) > 0).all() for s, e in zip(b.starts, b.ends))
        return {"k": b["producto_id"][b.starts], "n": b.ends - b.starts}

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, target in ((7, 10), (100, 50), (10_000, 50_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {r.k: r.n for r in map_series(df, kernel, "k int, n bigint", target_rows=target).collect()}
            assert got == {r.producto_id: r["count"] for r in df.groupBy("producto_id").count().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
