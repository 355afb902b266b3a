"""Schemas that drift between deliveries: profile, match and unify the fields of JSON rows."""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.joins import asof
from lonja.session import written

#: The kinds of a JSON value.
KINDS = {bool: "booleano", int: "numero", float: "numero", str: "texto", list: "lista", dict: "objeto"}
#: Distinct values kept in a sketch (those with the smallest hashes).
SKETCH = 16
DIGIT = re.compile(r"\d")


@lru_cache(maxsize=4096)
def field_name(s: str) -> str:
    """Lower case, no accents, words joined by `_`."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")


def mean(values: Sequence[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def rows_of(text: str | None) -> list[dict]:
    """The JSON rows of a delivery; anything that is no array of objects has none."""
    try:
        rows = json.loads(text) if text else []
    except ValueError:
        return []
    return [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


def profile(text: str | None) -> list[list]:
    """[name, kind, size, digits, hashes] of each field, in the order that most rows have.

    kind: of the most values, null if all are null; size: mean log magnitude of numbers or mean
    length of texts; digits: share of digits in texts; hashes: a bottom-k sketch of the values.
    """
    rows = rows_of(text)
    orders = [tuple(dict.fromkeys(field_name(k) for k in r)) for r in rows]
    if not orders:
        return []
    # The usual order: that of the most rows, then of the first one; rows may be shuffled or lack fields.
    count = Counter(orders)
    lead = max(orders, key=lambda o: (count[o], len(o)))
    names = list(lead)
    for o in orders:
        for i, k in enumerate(o):
            if k not in names:  # behind the field it follows in its row
                before = [names.index(x) for x in o[:i] if x in names]
                names.insert(before[-1] + 1 if before else 0, k)
    values: dict[str, list] = {k: [] for k in names}
    for r in rows:
        for k, v in r.items():
            if v is not None:
                values[field_name(k)].append(v)
    out = []
    for k in names:
        kinds = Counter(KINDS[type(v)] for v in values[k])
        kind = kinds.most_common(1)[0][0] if kinds else None
        own = [v for v in values[k] if KINDS[type(v)] == kind]
        if kind == "numero":
            size, digits = mean([math.log10(abs(v) + 1e-3) for v in own]), 0.0
        else:
            texts = [v if isinstance(v, str) else json.dumps(v) for v in own]
            size = mean([len(t) for t in texts])
            digits = mean([len(DIGIT.findall(t)) / max(1, len(t)) for t in texts])
        hashes = sorted({zlib.crc32(repr(v).encode()) for v in own})[:SKETCH]
        out.append([k, kind, size, digits, hashes])
    return out


def likeness(a: list, b: list) -> float:
    """Cost of taking field b for field a, by kind, values and name: 0 alike, about 3 unlike."""
    cost = 0.0 if a[1] == b[1] or not a[1] or not b[1] else 1.0
    if a[1] == b[1] == "numero":
        cost += min(1.0, abs(a[2] - b[2]) / 3)
    elif a[1] == b[1]:
        cost += min(0.5, abs(a[2] - b[2]) / 40) + min(0.5, abs(a[3] - b[3]))
    x, y = set(a[4]), set(b[4])
    cost += 0.5 * (1 - len(x & y) / len(x | y)) if x and y else 0.25
    g, h = ({s[i : i + 2] for i in range(len(s) - 1)} or {s} for s in (a[0], b[0]))
    return cost + 0.5 * (1 - len(g & h) / len(g | h))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, min(rows, columns) of them (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assignment(cost.T)]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < low[free]
            low[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def changes(old: list[list], new: list[list], most: float = 2.0) -> list[tuple[str, str, str | None]]:
    """(field, change, new name of a renamed one) between two profiles.

    A field is renamed if the best matching of the fields gone with the fields added pairs it with
    one in the same place (as many common fields stand before it) at a cost of at most `most`.
    """
    a, b = {f[0]: f for f in old}, {f[0]: f for f in new}
    gone, added = [f for f in old if f[0] not in b], [f for f in new if f[0] not in a]
    renamed: dict[str, str] = {}
    if gone and added:
        far = 100.0
        slot_a = [sum(x[0] in b for x in old[: old.index(f)]) for f in gone]
        slot_b = [sum(x[0] in a for x in new[: new.index(f)]) for f in added]
        cost = np.full((len(gone), len(added)), far)
        for slot in {*slot_a} & {*slot_b}:
            i, j = ([k for k, s in enumerate(side) if s == slot] for side in (slot_a, slot_b))
            # As many gone as added in one slot: each stands for the one in its place.
            turn = 2.0 if len(i) == len(j) else 0.1
            for m, x in enumerate(i):
                for n, y in enumerate(j):
                    cost[x, y] = likeness(gone[x], added[y]) + turn * abs(m - n)
        renamed = {gone[i][0]: added[j][0] for i, j in assignment(cost) if cost[i, j] <= most}
    out = [(x, "renombrado", y) for x, y in renamed.items()]
    out += [(f[0], "retirado", None) for f in gone if f[0] not in renamed]
    out += [(f[0], "agregado", None) for f in added if f[0] not in renamed.values()]
    for f in old:
        g = b.get(renamed.get(f[0], f[0]))
        if g and f[1] and g[1] and f[1] != g[1]:
            out.append((f[0], "tipo", None))
    return out


def deliveries(df: DataFrame, key: str, source: str, order: str, content: str) -> DataFrame:
    """One row for each delivery: copies of a key count once, the largest content among differing ones."""
    rows = df.groupBy(key).agg(F.max(F.struct(order, source, content)).alias("_r"))
    return rows.select(key, *[F.col("_r")[c].alias(c) for c in (source, order, content)])


def drift(df: DataFrame, key: str = "reporte_id", source: str = "fuente", order: str = "fecha", content: str = "contenido") -> DataFrame:
    """Every change between a delivery and the one of the same source before it.

    Result: key, source, order, campo, cambio (agregado, retirado, renombrado, tipo), nuevo (the new
    name of a renamed field). Deliveries with a null date have no place in the order and are left
    out, as are those with a null source; content that is no JSON array of objects has no fields.
    Ties in the date are ordered by key. The delivery before is sought within tiles of a month, and
    for the first of a tile in the tile before it, so a source of any share of the rows is spread
    over its months.
    """

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [profile(t) for t in b.column(content).to_pylist()]
            kinds_of = pa.array(["|".join(sorted(f"{f[0]}:{f[1] or ''}" for f in p)) for p in made], pa.string())
            columns = [*(b.column(c) for c in (key, source, order)), pa.array([json.dumps(p) for p in made], pa.string()), kinds_of]
            yield pa.RecordBatch.from_arrays(columns, names=[key, source, order, "perfil", "firma"])

    kinds = dict(df.dtypes)
    rows = deliveries(df, key, source, order, content).where(F.col(order).isNotNull() & F.col(source).isNotNull())
    rows = rows.mapInArrow(profiles, f"{key} {kinds[key]}, {source} {kinds[source]}, {order} {kinds[order]}, perfil string, firma string")
    rows = rows.select(key, source, order, F.struct("perfil", "firma").alias("_p"))
    rows = written(rows.withColumn("_tile", F.trunc(order, "month")), "profiles")
    within = Window.partitionBy(source, "_tile").orderBy(order, key)
    near = rows.withColumns({"_before": F.lag("_p").over(within), "_first": F.row_number().over(within) == 1})
    last = rows.groupBy(source, "_tile").agg(F.max_by("_p", F.struct(order, key)).alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(source).orderBy("_tile"))).select(source, "_tile", "_carried")
    pairs = near.join(last.where(F.col("_carried").isNotNull()), [source, "_tile"], "left")
    pairs = pairs.withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
    # Equal names and kinds, whatever their order and values, are no change.
    pairs = pairs.where(F.col("_before.firma") != F.col("_p.firma")).select(key, source, order, F.col("_before.perfil").alias("_before"), F.col("_p.perfil").alias("perfil"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (x, y) in enumerate(zip(b.column("_before").to_pylist(), b.column("perfil").to_pylist())):
                found = changes(json.loads(x), json.loads(y))
                at += [i] * len(found)
                out += found
            took = [b.column(c).take(pa.array(at, pa.int64())) for c in (key, source, order)]
            yield pa.RecordBatch.from_arrays([*took, *(pa.array([o[k] for o in out], pa.string()) for k in range(3))], names=[key, source, order, "campo", "cambio", "nuevo"])

    return pairs.mapInArrow(compare, f"{key} {kinds[key]}, {source} {kinds[source]}, {order} {kinds[order]}, campo string, cambio string, nuevo string")


def canonical_names(found: DataFrame, source: str = "fuente", order: str = "fecha") -> DataFrame:
    """For each source and renamed field, what it was first called: source, nombre, desde, canonico.

    Chains of renames are shortened by pointer jumping: each round replaces a name's origin by the
    origin of that origin, so a chain of n renames takes log2(n) rounds. The origin's own rename is the
    last one before, found by an as-of join, so a field renamed to and fro makes no pairs.
    """
    renames = found.where("cambio = 'renombrado'").groupBy(source, F.col("nuevo").alias("nombre"), F.col(order).alias("desde")).agg(F.min("campo").alias("canonico"))
    edges = written(renames.withColumn("_at", F.col("desde")), "renames")
    while True:
        left = edges.select(source, "nombre", "desde", F.col("canonico").alias("_name"), "_at")
        right = edges.select(source, F.col("nombre").alias("_name"), F.col("desde").alias("_at"), F.col("canonico").alias("_origin"), F.col("_at").alias("_since"))
        step = asof(left, right, [source, "_name"], "_at", ["_origin", "_since"], strict=True)
        moved = F.col("_origin_asof").isNotNull()
        step = step.select(source, "nombre", "desde", F.coalesce("_origin_asof", "_name").alias("canonico"), F.coalesce("_since_asof", "_at").alias("_at"), moved.alias("_moved"))
        step = written(step, "renames")
        edges = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            return edges.drop("_at")


def unify(df: DataFrame, found: DataFrame, key: str = "reporte_id", source: str = "fuente", order: str = "fecha", content: str = "contenido") -> DataFrame:
    """One table of consistent fields: key, linea, campo (the field's first name), nombre (as delivered), tipo, valor.

    Values come as text: texts as they are, all else as JSON; nulls stay null. Rows of deliveries
    without date or source keep their own names.
    """
    kinds = dict(df.dtypes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: list[Sequence] = []
            for i, t in enumerate(b.column(content).to_pylist()):
                for line, r in enumerate(rows_of(t)):
                    for k, v in r.items():
                        at.append(i)
                        out.append((line, field_name(k), KINDS.get(type(v)), v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)))
            took = [b.column(c).take(pa.array(at, pa.int64())) for c in (key, source, order)]
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*took, *made], names=[key, source, order, "linea", "nombre", "tipo", "valor"])

    held = deliveries(df, key, source, order, content)
    rows = held.mapInArrow(cells, f"{key} {kinds[key]}, {source} {kinds[source]}, {order} {kinds[order]}, linea int, nombre string, tipo string, valor string")
    # Each renamed name on each day of its source, with its origin: by these days a source of any share of the rows is spread.
    names = written(canonical_names(found, source, order), "origins")
    days = held.where(F.col(order).isNotNull()).select(source, order).distinct()
    asked = days.join(names.select(source, "nombre").distinct(), source).select(source, order, "nombre")
    then = asof(asked, names.select(source, "nombre", F.col("desde").alias(order), "canonico"), [source, "nombre"], order, ["canonico"])
    origin = then.where(F.col("canonico_asof").isNotNull()).select(F.col(source).alias("_s"), F.col(order).alias("_o"), F.col("nombre").alias("_n"), F.col("canonico_asof").alias("_c"))
    rows = rows.join(origin, (rows[source] == origin["_s"]) & (rows[order] == origin["_o"]) & (rows["nombre"] == origin["_n"]), "left")
    return rows.select(key, "linea", F.coalesce("_c", "nombre").alias("campo"), "nombre", "tipo", "valor")
