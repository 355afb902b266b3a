"""Long spans that stand verbatim in more than one document: winnowed seeds, extended both ways.

By winnowing, any two copies of a stretch of `length` characters hold a seed at the same place. So
seeds that stand in one document only are dropped, and each other seed is looked at with what stands
around it, as far as a stretch that holds it can reach. Occurrences with the same surroundings are one,
however many documents they stand in; the different surroundings of a seed are extended both ways
against one another, and each repeat that comes of it is told by its class: the least document and place
it stands at. Seeds with very many different surroundings (a formula within ever other texts) are not
compared with one another but cut into windows, which are matched by 128-bit hashes and counted.
Pairs of documents are never made, nor is the list of a passage's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lonja.operators.series import Block, map_series
from lonja.operators.skew import join_counted
from lonja.session import written

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Hashes of all windows of a length, modulo 2**64, by prefix sums of powers of an odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = 2 * n
            self.powers, self.inverses = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (self.base, self.inverse))

    def windows(self, codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes)
        if n < length:
            return np.zeros(0, np.uint64)
        self._reach(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(self.base)) * self.powers[:n], out=prefix[1:])
        return mixed((prefix[length:] - prefix[:-length]) * self.inverses[: n - length + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) of each window of w values, by block prefixes and suffixes."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.r_[x, np.repeat(x[-1:], -n % w)].reshape(-1, w)
    left = best.accumulate(pad, axis=1).ravel()
    right = best.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n])


def seeds(hashes: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: the places that hold the least hash of some window of w hashes, ties included."""
    least = sliding(hashes, w, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    none = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(sliding(np.r_[none, least, none], w, np.maximum) == hashes)


#: Different surroundings of a seed that are compared with one another; of more, windows are counted.
MOST = 64


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, seed: int = 100, most: int = MOST) -> DataFrame:
    """key, inicio, fin, clase, clase_inicio, veces: stretches of at least `length` code points, around one
    seed each, that stand verbatim in another document too.

    clase and clase_inicio are the least document and the least place in it where the same stretch stands,
    so all documents that share a stretch share a class; veces is in how many places it stands. A stretch
    reaches as far as its two copies agree, at most `length` - `seed` from its seed; longer ones come as
    overlapping pieces (see `classes`). Documents are different if their keys are: a repetition within one
    document, or within repeated rows of one key, is no case. Rows with a null key cannot be told apart
    and are left out; null, empty and shorter texts have no spans. Other columns are not read. A seed
    with over `most` different surroundings is taken window by window; the result is the same but for
    the pieces it comes in.
    """
    kind = dict(docs.dtypes)[key]
    reach = length - seed
    rows = docs.where(F.col(key).isNotNull() & (F.length(text) >= length)).select(F.col(key).alias("_d"), F.xxhash64(text).alias("_x"), F.col(text).alias("_t"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(BASES[0])
        for b in batches:
            place, values, count = [], [], []
            for t in b.column("_t"):
                h = roll.windows(code_points(t.as_py()), seed)
                at = seeds(h, reach + 1)
                place.append(at)
                values.append(h[at])
                count.append(len(at))
            of = pa.array(np.repeat(np.arange(b.num_rows), count))
            hashes = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            places = np.concatenate([np.zeros(0, np.int64), *place]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("_d").take(of), b.column("_x").take(of), pa.array(hashes), pa.array(places)], names=["_d", "_x", "h", "pos"])

    anchors = written(rows.mapInArrow(find, f"_d {kind}, _x bigint, h bigint, pos int"), "seeds")
    common = written(_in_two(anchors, ["h"]), "common-seeds")
    places = join_counted(anchors, common, ["h"]).groupBy("_d", "_x").agg(F.collect_set(F.struct("pos", "h")).alias("_p"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[int] = []
            lefts: list[str] = []
            rights: list[str] = []
            pos: list[int] = []
            hashes: list[int] = []

            def flush() -> pa.RecordBatch:
                made = [b.column("_d").take(pa.array(of, pa.int64())), pa.array(hashes, pa.int64()), pa.array(pos, pa.int32()), pa.array(lefts, pa.string()), pa.array(rights, pa.string())]
                for x in (of, lefts, rights, pos, hashes):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, names=["_d", "h", "pos", "izquierda", "derecha"])

            for i in range(b.num_rows):
                t = b.column("_t")[i].as_py()
                for p, h in zip(b.column("_pos")[i].as_py(), b.column("_h")[i].as_py()):
                    of.append(i)
                    pos.append(p)
                    hashes.append(h)
                    lefts.append(t[max(0, p - reach) : p][::-1])
                    rights.append(t[p : p + length])
                    if len(of) == 8192:  # a long text leaves in batches of bounded size
                        yield flush()
            yield flush()

    around = rows.join(places, ["_d", "_x"]).select("_d", "_t", F.col("_p.pos").alias("_pos"), F.col("_p.h").alias("_h"))
    around = around.mapInArrow(surround, f"_d {kind}, h bigint, pos int, izquierda string, derecha string")
    around = written(around.withColumn("g", F.xxhash64("izquierda", "derecha")), "surroundings")
    once = around.groupBy("h", "g", "izquierda", "derecha").agg(F.min(F.struct("_d", "pos")).alias("_a"), F.max("_d").alias("_b"), F.count("*").alias("n"))
    once = written(once.select("h", "g", "izquierda", "derecha", F.col("_a._d").alias("_a"), F.col("_a.pos").alias("_at"), "_b", "n"), "different")
    ways = once.groupBy("h").agg(F.count("*").alias("_m"))
    sized = join_counted(once, ways.withColumn("_n", F.col("_m")), ["h"], "_n")

    def extend(b: Block) -> dict[str, pa.Array | pa.ChunkedArray | np.ndarray]:
        of, left, right, rep, times = extended(b, length, seed)
        column = lambda c, at: b.columns.column(c).take(pa.array(at))
        return {"h": b["h"][of], "g": b["g"][of], "_l": left, "_r": right, "clase": column("_a", rep), "_at": b["_at"][rep], "veces": times, "_n": b["n"][of]}

    held = map_series(sized.where(F.col("_m") <= most).drop("_m"), extend, f"h bigint, g bigint, _l int, _r int, clase {kind}, _at int, veces bigint, _n bigint", keys=["h"], order="g")
    near = join_counted(around.select("_d", "pos", "h", "g"), written(held, "extended"), ["h", "g"], "_n")
    start, end = F.col("pos") - F.col("_l"), F.col("pos") + F.col("_r")
    out = near.select(F.col("_d").alias(key), start.cast("bigint").alias("inicio"), end.cast("bigint").alias("fin"), "clase", (F.col("_at") - F.col("_l")).cast("bigint").alias("clase_inicio"), "veces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [Rolling(x) for x in BASES]
        for b in batches:
            for i in range(b.num_rows):
                left = b.column("izquierda")[i].as_py()[::-1]
                codes = code_points(left + b.column("derecha")[i].as_py())
                made = [r.windows(codes, length).view(np.int64) for r in rolls]
                at = np.arange(len(made[0])) + b.column("pos")[i].as_py() - len(left)
                of = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([b.column("_d").take(of), *map(pa.array, made), pa.array(at.astype(np.int32))], names=["_d", "u", "v", "pos"])

    many = written(ways.where(F.col("_m") > most).select("h", F.col("_m").alias("_n")), "many")
    if many.limit(1).count():
        windows = join_counted(around.select("_d", "pos", "h", "izquierda", "derecha"), many, ["h"], "_n").mapInArrow(cut, f"_d {kind}, u bigint, v bigint, pos int")
        windows = written(windows.distinct(), "windows")
        twice = windows.groupBy("u", "v").agg(F.min(F.struct("_d", "pos")).alias("_a"), F.max("_d").alias("_b"), F.count("*").alias("n"))
        twice = written(twice.where(F.col("_a._d") < F.col("_b")).select("u", "v", F.col("_a._d").alias("clase"), F.col("_a.pos").alias("_at"), F.col("n").alias("veces"), "n"), "common-windows")
        found = join_counted(windows, twice, ["u", "v"])
        out = out.unionByName(found.select(F.col("_d").alias(key), F.col("pos").cast("bigint").alias("inicio"), (F.col("pos") + length).cast("bigint").alias("fin"), "clase", F.col("_at").cast("bigint").alias("clase_inicio"), "veces"))
    return out


def extended(b: Block, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(surrounding, left, right, representative, times) of each repeat among the surroundings of each seed.

    A block has the columns izquierda (what stands before the seed, backwards), derecha (the seed and
    what follows), _a and _b (least and greatest document), _at (least place in _a), n. left and right
    are counted from the seed's place. Seeds with equally many surroundings are taken together.
    """
    lefts, rights = (b.columns.column(c).to_pylist() for c in ("izquierda", "derecha"))
    size_l, size_r = (np.array([len(x) for x in xs], np.int64) for xs in (lefts, rights))
    codes_l = code_points("".join(x.ljust(length - seed, "\0") for x in lefts)).reshape(b.n, -1)
    codes_r = code_points("".join(x.ljust(length, "\0") for x in rights)).reshape(b.n, -1)
    docs = np.concatenate([b["_a"], b["_b"]])
    first, last = np.unique(docs, return_inverse=True)[1].reshape(2, -1)
    order = np.lexsort((b["_at"], first))
    rank = np.empty(b.n, np.int64)
    rank[order] = np.arange(b.n)
    many = b.ends - b.starts
    out: list[tuple[np.ndarray, ...]] = []
    for m in np.unique(many):
        of_size = b.starts[many == m]
        step = max(1, 40_000 // int(m) ** 2)
        for lo in range(0, len(of_size), step):
            at = of_size[lo : lo + step, None] + np.arange(m)
            left = _agree(codes_l[at], size_l[at])
            right = _agree(codes_r[at], size_r[at])
            x, y = at[:, :, None], at[:, None, :]
            differ = (first[x] != last[x]) | (first[y] != last[y]) | (first[x] != first[y])
            c, i, j = np.nonzero((right >= seed) & (left + right >= length) & differ)
            l, r = left[c, i, j], right[c, i, j]
            # One row for each different stretch around a place.
            keep = np.unique(((c * m + i) * (length + 1) + l) * (length + 1) + r, return_index=True)[1]
            c, i, l, r = c[keep], i[keep], l[keep], r[keep]
            for part in range(0, len(c), 65_536):
                p = slice(part, part + 65_536)
                same = (left[c[p], i[p]] >= l[p, None]) & (right[c[p], i[p]] >= r[p, None])
                rows = at[c[p]]
                rep = order[np.where(same, rank[rows], b.n).min(1)]
                out.append((rows[np.arange(len(rows)), i[p]], l[p], r[p], rep, np.where(same, b["n"][rows], 0).sum(1)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def _agree(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first letters each two rows of (group, row, letter) have in common."""
    other = codes[:, :, None, :] != codes[:, None, :, :]
    alike = np.where(other.any(-1), other.argmax(-1), codes.shape[-1])
    return np.minimum(alike, np.minimum(size[:, :, None], size[:, None, :]))


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, seed: int = 100, most: int = MOST) -> DataFrame:
    """key, inicio, fin: the maximal stretches of each document covered by spans of at least `length`
    code points that stand verbatim in another document too; overlapping and touching ones are one.

    What counts as a document and as a span is said at `repeats`, whose stretches these are put together of.
    """
    found = repeats(docs, key, text, length, seed, most).select(F.col(key).alias("_d"), "inicio", "fin")

    def merge(b: Block) -> dict[str, np.ndarray]:
        first, fin = _joined(b.series, b["inicio"], b["fin"])
        return {key: b.columns.column("_d").take(pa.array(first)), "inicio": b["inicio"][first], "fin": fin}

    out = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL("inicio bigint, fin bigint").fields])
    return map_series(found, merge, out, keys=["_d"], order="inicio")


def classes(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, inicio, fin, clase, clase_inicio, veces: the pieces of `repeats`, put together to whole repeats.

    Pieces that overlap or touch and lie alike in the document and in the class's least document are one
    stretch, veces the most of them. A class's least document has a row for itself; every other document
    that shares the stretch is linked with it by its row, so no link between documents is lost and none is
    spelled out pair by pair.
    """
    rows = found.select(F.col(key).alias("_d"), "clase", (F.col("inicio") - F.col("clase_inicio")).alias("_o"), "inicio", "fin", "veces")

    def merge(b: Block) -> dict[str, np.ndarray]:
        first, fin = _joined(b.series, b["inicio"], b["fin"])
        take = lambda c: b.columns.column(c).take(pa.array(first))
        times = np.maximum.reduceat(b["veces"], first) if len(first) else b["veces"]
        return {key: take("_d"), "inicio": b["inicio"][first], "fin": fin, "clase": take("clase"), "clase_inicio": b["inicio"][first] - b["_o"][first], "veces": times}

    kind = found.schema[key].dataType
    out = StructType([StructField(key, kind), *StructType.fromDDL("inicio bigint, fin bigint").fields, StructField("clase", kind), *StructType.fromDDL("clase_inicio bigint, veces bigint").fields])
    return map_series(rows, merge, out, keys=["_d", "clase", "_o"], order="inicio")


def _joined(series: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, end) of each run of overlapping or touching intervals; rows by series, then start."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.int64(end.max() + 1)
    reached = np.maximum.accumulate(end + series * far)
    first = np.flatnonzero(np.r_[True, (start[1:] + series[1:] * far > reached[:-1])])
    return first, np.maximum.reduceat(end, first)


def _in_two(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys that stand in two documents at least, and their number of rows."""
    both = rows.groupBy(*on).agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"), F.count("*").alias("n"))
    return both.where(F.col("_a") < F.col("_b")).select(*on, "n")


def shares(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, caracteres, compartidos, parte: how much of each text stands in another document.

    One row for each row of docs; texts without characters share nothing, and their part is null.
    """
    sums = spans.groupBy(key).agg(F.sum(F.col("fin") - F.col("inicio")).alias("_s"))
    size = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    rows = docs.select(key, size.alias("caracteres")).join(sums, key, "left").withColumn("compartidos", F.coalesce("_s", F.lit(0)).cast("bigint"))
    return rows.select(key, "caracteres", "compartidos", F.try_divide(F.col("compartidos").cast("double"), F.col("caracteres").cast("double")).alias("parte"))
