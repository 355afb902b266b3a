"""Filling containers of fixed capacity: best fit decreasing on a tree over remaining capacities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.session import written


class Room:
    """Open containers by what they have left: a segment tree over 0..capacity.

    A node counts the containers below it, so the tightest one with room for an item is found by
    one way up and one way down the tree.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, left: int, container: int) -> None:
        self.open.setdefault(left, []).append(container)
        at = left + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(container, what it has left) of the tightest container with room; it is taken out."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        left = at - self.leaves
        container = self.open[left].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return container, left


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """The container of each item, and the content of each container.

    Items are placed from the largest on, equal ones in their order; none is larger than capacity.
    """
    room, where, content = Room(capacity), [0] * len(sizes), []
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = int(sizes[i])
        found = room.take(size)
        if found is None:
            found = len(content), capacity
            content.append(0)
        container, left = found
        where[i] = container
        content[container] += size
        room.add(left - size, container)
    return where, content


def containers(
    sizes: DataFrame,
    key: str = "doc_id",
    size: str = "tokens",
    capacity: int = 2048,
    shard_items: int = 100_000,
    loose: float = 0.97,
) -> DataFrame:
    """key, parte, inicio, size, contenedor: every item in a container.

    An item larger than `capacity` alone is split into parts of `capacity` and a rest; no other is.
    Items of size 0 (null counts as 0) take the tightest container too. Items are spread by their
    place in the input, so those with null or repeated keys are too, over shards of about `shard_items`,
    each packed by best fit decreasing; what lies in containers filled below `loose` is packed once
    more, over fewer shards, until one shard is left or nothing is gained. A shard has about `shard_items` items at any corpus size, whatever the sizes are.
    Repeated rows are items of their own. Empty input: empty result.
    """
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    parts = sizes.select(key, whole.alias("_n")).select(key, "_n", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0)))).alias("parte", "_p"))
    inicio = F.col("parte").cast("bigint") * capacity
    items = parts.select(key, "parte", inicio.alias("inicio"), F.least(F.col("_n") - inicio, F.lit(capacity)).alias(size), F.monotonically_increasing_id().alias("_row"))
    items = written(items, "items")
    kind = dict(sizes.dtypes)[key]
    done: list[DataFrame] = []
    base, level, before = 0, 0, None
    while True:
        count = items.count()
        shards = max(1, -(-count // shard_items))
        packed = written(_packed(items, key, kind, size, capacity, shards, base, level), "packed")
        base += shards
        if shards == 1 or (before is not None and shards >= before):
            done.append(packed)
            break
        full = F.col("_fill") >= loose * capacity
        done.append(packed.where(full))
        items, before, level = packed.where(~full).select(key, "parte", "inicio", size, "_row"), shards, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(key, "parte", "inicio", size, "contenedor")


def _packed(items: DataFrame, key: str, kind: str, size: str, capacity: int, shards: int, base: int, level: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            shard = t.column("_shard").to_numpy()
            for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if not len(part):
                    continue
                rows = t.slice(int(part[0]), len(part))
                where, content = best_fit_decreasing(rows.column(size).to_pylist(), capacity)
                at = np.asarray(where, np.int64)
                number = (base + int(shard[part[0]])) * (1 << 32) + at
                fill = np.asarray(content, np.int64)[at]
                out = rows.drop_columns(["_shard"]).append_column("contenedor", pa.array(number)).append_column("_fill", pa.array(fill))
                yield from out.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            shard = b.column("_shard")
            if shard[0] != shard[len(shard) - 1] or held[0].column("_shard")[0] != shard[0]:
                t = pa.Table.from_batches(held)
                s = t.column("_shard").to_numpy()
                cut = int(np.searchsorted(s, s[-1]))
                yield from flush(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    shard = F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(shards)).cast("int")
    spread = items.withColumn("_shard", shard).repartition(shards, "_shard").sortWithinPartitions("_shard", F.desc(size), key, "parte", "_row")
    return spread.mapInArrow(pack, f"{key} {kind}, parte int, inicio bigint, {size} bigint, _row bigint, contenedor bigint, _fill bigint")
