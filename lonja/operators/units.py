"""Quantities in different units and money scales: read from the text, and decoded from the values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import deaccent
from lonja.operators.series import Block

#: How the named measures of weight are written.
SPELLINGS = {
    "Kilogramo": "kg|kgs|kilo|kilos|kilogramo|kilogramos",
    "Gramo": "g|gr|grs|gramo|gramos",
    "Libra": "lb|lbs|libra|libras",
    "Arroba": "@|arroba|arrobas|arrob",
    "Quintal": "qq|quintal|quintales",
    "Tonelada": "t|tm|tn|ton|tonelada|toneladas",
}
#: Words that say a price is in hundredths.
HUNDREDTHS = r"\b(ctvs?|cts?|cents?|centimos?|centavos?)\b"


def measure_of(text: str | Column) -> tuple[Column, Column, Column]:
    """(number, named measure, hundredths) of a unit's text.

    "Saco x 60 Kg." -> (60, Kilogramo, false); "lb" -> (null, Libra, false); "Kg - céntimos" ->
    (null, Kilogramo, true); a container without weight -> (null, null, ...). Null text: (null, null, false).
    """
    t = F.lower(deaccent(text))
    hundredths = F.coalesce(t.rlike(HUNDREDTHS), F.lit(False))
    t = F.regexp_replace(t, HUNDREDTHS, " ")
    every = "|".join(SPELLINGS.values())
    weight = rf"(\d+(?:[.,]\d+)?)\s*({every})(?![a-z0-9])"
    number = F.regexp_replace(F.regexp_extract(t, weight, 1), ",", ".").try_cast("double")
    name = F.regexp_extract(t, weight, 2)
    alone = F.regexp_extract(t, rf"^[^a-z0-9@]*(?:por |x |en )?\s*({every})(?![a-z0-9])", 1)
    word = F.when(number.isNotNull(), name).otherwise(alone)
    named = F.lit(None).cast("string")
    for measure, words in SPELLINGS.items():
        named = F.when(word.rlike(f"^(?:{words})$"), measure).otherwise(named)
    return number, named, hundredths


def with_unit(df: DataFrame, measures: DataFrame, containers: DataFrame, text: str = "unidad", product: str = "producto_id") -> DataFrame:
    """Adds `_kg` (kilograms of one published unit), `_hundredths` and `_silent` (the text says nothing).

    A weight in the text comes first, then a named measure of `measures` (unidad, equiv_kg), then
    the weight of the product's container in `containers` (id, equiv_kg); null if none is known.
    Both are dimension tables: Spark broadcasts them while they are small enough
    (spark.sql.autoBroadcastJoinThreshold) and joins by key beyond.
    """
    number, named, hundredths = measure_of(text)
    m = measures.groupBy(F.col("unidad").alias("_named")).agg(F.max("equiv_kg").alias("_measure_kg"))
    c = containers.groupBy(F.col("id").alias("_container")).agg(F.max("equiv_kg").alias("_container_kg"))
    rows = df.withColumns({"_number": number, "_named_": named, "_hundredths": hundredths})
    rows = rows.join(m, rows["_named_"] == m["_named"], "left").join(c, rows[product] == c["_container"], "left")
    kg = F.when(F.col("_named_").isNotNull(), F.col("_measure_kg") * F.coalesce("_number", F.lit(1.0))).otherwise(F.col("_container_kg"))
    silent = F.coalesce(~F.col(text).rlike(r"[\p{L}@]"), F.lit(True))
    return rows.withColumns({"_kg": F.when(kg > 0, kg), "_silent": silent}).drop("_number", "_named_", "_named", "_measure_kg", "_container", "_container_kg")


@dataclass(frozen=True)
class ScaleModel:
    """Hidden Markov model of the scale that a series is published in.

    offsets: log factor of each state over the scale that its text says; state 0 is the text's.
    switch: log probability of a change of state. start: log probability to begin outside state 0.
    step, level: widths of the day-to-day moves and of the values about the reference level.
    outlier: log density of a move or value of any size. With these, a foreign scale must last
    for four readings to be read as a switch; shorter ones are left to the spike filter.
    silent: log probability of a change of state where the text says nothing, so that nothing but the
    values speaks for the unit of such a reading. units: kilograms of the units that it may be in
    besides its container; each is a state with each of the offsets.
    """

    offsets: tuple[float, ...] = (0.0, math.log(100))
    switch: float = -20.0
    start: float = -7.0
    step: float = 0.15
    level: float = 0.7
    outlier: float = -7.0
    silent: float = -4.0
    units: tuple[float, ...] = ()

    def density(self, z: np.ndarray, width: float) -> np.ndarray:
        normal = -0.5 * (z / width) ** 2 - math.log(width * math.sqrt(2 * math.pi))
        with np.errstate(invalid="ignore"):  # no value, no density
            return np.logaddexp(normal, self.outlier)


def viterbi(y: np.ndarray, anchor: np.ndarray, marked: np.ndarray, series: np.ndarray, model: ScaleModel, silent: np.ndarray | None = None, kg: np.ndarray | None = None) -> np.ndarray:
    """The most likely state of each reading.

    y: log values, NaN where a row has none (its state is that of its neighbours). anchor: reference
    level on each row, NaN if unknown. marked: rows whose text states the scale, so state 0 holds.
    series: codes 0..n-1, rows in order. All series advance together, one reading at a time.
    silent: rows whose text says nothing, with kg, the kilograms that y takes their unit for. They alone
    can be in the states after those of the offsets: state i * len(offsets) + s is the i-th of the
    model's units (from 1) in scale s.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    n = np.bincount(series)
    start = np.cumsum(n) - n
    place = np.arange(len(y)) - start[series]
    scales = np.array(model.offsets)
    many = silent is not None and bool(silent.any()) and len(model.units) > 0
    rows, length, k = len(n), int(n.max()), len(scales) * (1 + len(model.units) if many else 1)
    order = np.argsort(-n, kind="stable")  # series by falling length: those still running are a prefix
    rank = np.empty(rows, int)
    rank[order] = np.arange(rows)

    def laid(values: np.ndarray, rest: object) -> np.ndarray:
        out = np.full((rows, length), rest)
        out[rank[series], place] = values
        return out

    grid, about, fixed = laid(y, np.nan), laid(anchor, np.nan), laid(marked, False)
    quiet = laid(silent, False) if many else np.zeros((1, length), bool)
    unit_log = np.log(laid(kg, 1.0)) if many else None
    running = np.searchsorted(-n[order], -np.arange(length), side="left")
    same = np.eye(k, dtype=bool)
    score = np.where(np.arange(k) == 0, 0.0, model.start) * np.ones((rows, 1))
    back = np.zeros((length, rows, k), np.int8)
    last = np.full(rows, np.nan)
    last_off = np.zeros((rows, k))
    for t in range(length):
        m = running[t]
        v = grid[:m, t]
        there = ~np.isnan(v)
        if many:  # a unit's offset is that over the one that y takes the text for
            units = np.log(np.array(model.units))[None] - unit_log[:m, t, None]
            off = (np.concatenate([np.zeros((m, 1)), units], 1)[:, :, None] + scales).reshape(m, k)
            before = quiet[:m, t - 1] if t else quiet[:m, t]
            cost = np.where(quiet[:m, t] | before, model.silent, model.switch)[:, None, None]
        else:
            off, cost = np.broadcast_to(scales, (m, k)), model.switch
        change = np.where(same[None], 0.0, cost if t else -np.inf)
        # A move between two readings is the change of scale plus the move of the level.
        move = np.where(there & ~np.isnan(last[:m]), v - last[:m], np.nan)
        fit = model.density(move[:, None, None] - (off[:, None, :] - last_off[:m, :, None]), model.step)
        step = np.where(np.isnan(move)[:, None, None], 0.0, fit)
        come = score[:m, :, None] + step + change
        back[t, :m] = come.argmax(1)
        score[:m] = come.max(1)
        away = model.density(v[:, None] - off - about[:m, t, None], model.level)
        score[:m] += np.where(np.isnan(away), 0.0, away)
        score[:m, 1:] += np.where(fixed[:m, t, None], -1e6, 0.0)
        if many:
            score[:m, len(scales) :] += np.where(quiet[:m, t, None], 0.0, -1e6)
        last[:m] = np.where(there, v, last[:m])
        last_off[:m] = np.where(there[:, None], off, last_off[:m])
    path = np.zeros((rows, length), np.int64)
    now = score.argmax(1)
    for t in range(length - 1, -1, -1):
        m = running[t]
        path[:m, t] = now[:m]
        now[:m] = back[t, np.arange(m), now[:m]]
    return path[rank[series], place]


def known_units(measures: DataFrame, most: int = 32) -> tuple[float, ...]:
    """The kilograms of the named measures, for `ScaleModel.units`; a list of more than `most` is refused."""
    kg = [r[0] for r in measures.where("equiv_kg > 0").select("equiv_kg").distinct().orderBy("equiv_kg").limit(most + 1).collect()]
    if len(kg) > most:
        raise ValueError(f"more than {most} units")
    return tuple(kg)


def reference_levels(df: DataFrame, product: str = "producto_id", price: str = "precio_hoy_unit") -> DataFrame:
    """Median of the log price per kilogram of each product, over all its rows: `_anchor`."""
    y = F.log(F.col(price) / F.col("_kg") * F.when(F.col("_hundredths"), 0.01).otherwise(1.0))
    there = (F.col(price) > 0) & ~F.isnan(price) & F.col("_kg").isNotNull()
    return df.where(there).groupBy(F.col(product).alias("_anchor_of")).agg(F.percentile_approx(y, 0.5, 200).alias("_anchor"))


def converted(b: Block, price: str = "precio_hoy_unit", model: ScaleModel = ScaleModel()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(price per kilogram in whole money, scale, kilograms of the unit) of each row of a block with `_kg`,
    `_hundredths`, `_silent`, `_anchor`.

    A price without value, or in an unknown unit, comes out as NaN.
    """
    kg, hundredths, silent, v = b["_kg"], b["_hundredths"].astype(bool), b["_silent"].astype(bool), b[price]
    taken = np.where(np.isnan(kg) & silent, 1.0, kg)  # without text and container, as if it were kilograms
    text = v / taken * np.where(hundredths, 0.01, 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.where(text > 0, np.log(np.where(text > 0, text, 1.0)), np.nan)
    state = viterbi(y, b["_anchor"], hundredths, b.series, model, silent, taken)
    scale, unit = state % len(model.offsets), state // len(model.offsets)
    own = np.where(unit > 0, np.array([1.0, *model.units])[unit], np.where(silent & np.isnan(kg), np.nan, kg))
    return v / own * np.where(hundredths, 0.01, 1.0) / np.exp(np.array(model.offsets))[scale], scale, own
