"""Streams: late rows, windows over event time, and an anomaly score that is kept as rows come."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lonja.sources.store import finish, upsert


def once_each(stream: DataFrame, keys: Sequence[str], at: str, late: str = "5 days") -> DataFrame:
    """Each key once while its copies come within `late` of each other in event time."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def upserted(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, date: str) -> StreamingQuery:
    """Bring what there is of a stream into a table; a batch that is run again changes nothing.

    The checkpoint makes the stream the table's one writer, so what an earlier run left undone is done first.
    """

    def batch(df: DataFrame, _: int) -> None:
        finish(df.sparkSession, path)
        upsert(df.sparkSession, path, df, keys, version, date)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, at: str, by: Sequence[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """inicio, fin, by, n, suma, minimo, maximo: tumbling or sliding windows; a stream drops rows over `late` late."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("suma"), F.min(value).alias("minimo"), F.max(value).alias("maximo"))
    return out.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), *by, "n", "suma", "minimo", "maximo")


def sessions(events: DataFrame, at: str, by: Sequence[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """inicio, fin, by, n: runs of events less than `gap` apart; fin is `gap` after the last one."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    out = timed.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), *by, "n")


def scored(stream: DataFrame, key: str, at: str, value: str, history: int = 30, least: int = 6) -> DataFrame:
    """key, at, value, z: each value against the median and MAD of the values of its key that came before.

    The state of a key is its last `history` values. Rows of one batch are taken in the order of `at`;
    rows without value are left out.
    """
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).dropna(subset=[value]).sort_values(at)
        z = []
        for v in rows[value]:
            z.append(score(held, v) if len(held) >= least else None)
            held = [*held, float(v)][-history:]
        state.update((held,))
        yield pd.DataFrame({key: rows[key], at: rows[at], value: rows[value], "z": pd.array(z, "Float64")})

    out = f"{key} {kinds[key]}, {at} {kinds[at]}, {value} {kinds[value]}, z double"
    return stream.groupBy(key).applyInPandasWithState(step, out, "v array<double>", "append", GroupStateTimeout.NoTimeout)


def score(held: Sequence[float], v: float) -> float | None:
    """(v - median) / (1.4826 MAD), else by the population deviation, else 99 with a sign; null if nothing differs."""
    x = np.asarray(held)
    centre = np.median(x)
    scale = np.median(np.abs(x - centre)) * 1.4826 or x.std()
    if scale:
        return float((v - centre) / scale)
    return None if v == centre else float(np.sign(v - centre) * 99)
