import random
from collections import Counter, defaultdict

import pytest

from lonja.llm.packing import Room, best_fit_decreasing, containers


def by_hand(sizes, capacity):
    left, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
        if fits:
            tight = min(r for r, _ in fits)
            b = [b for r, b in fits if r == tight][-1]
        else:
            b = len(left)
            left.append(capacity)
        left[b] -= sizes[i]
        where[i] = b
    return Counter(left)


@pytest.mark.parametrize("seed", range(5))
def test_same_room_left_as_by_hand(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    sizes = [rng.randint(0, capacity) for _ in range(200)]
    where, content = best_fit_decreasing(sizes, capacity)
    assert Counter(capacity - c for c in content) == by_hand(sizes, capacity)
    total = defaultdict(int)
    for i, b in enumerate(where):
        total[b] += sizes[i]
    assert [total[b] for b in range(len(content))] == content and max(content) <= capacity


def test_tightest_container():
    room = Room(10)
    for left, b in ((3, 0), (7, 1), (10, 2)):
        room.add(left, b)
    assert room.take(4) == (1, 7) and room.take(3) == (0, 3) and room.take(1) == (2, 10) and room.take(0) is None


def test_containers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 30, 50, 70, 99, 100])) for i in range(3000)] + [(9001, 250), (9002, 100), (9003, None), (9004, 101)]
    df = spark.createDataFrame([(i, n, "x", 5) for i, n in rows], "doc_id bigint, tokens bigint, contenedor string, parte int")
    for shard in (100_000, 500):
        out = containers(df, capacity=100, shard_items=shard).collect()
        whole = defaultdict(int)
        fill = defaultdict(int)
        parts = defaultdict(list)
        for r in out:
            whole[r.doc_id] += r.tokens
            fill[r.contenedor] += r.tokens
            parts[r.doc_id].append((r.parte, r.inicio, r.tokens))
        assert dict(whole) == {i: n or 0 for i, n in rows}
        assert max(fill.values()) <= 100
        assert sorted(parts[9001]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and sorted(parts[9004]) == [(0, 0, 100), (1, 100, 1)]
        assert all(len(p) == 1 for i, p in parts.items() if i not in (9001, 9004))
        least = -(-sum(n or 0 for _, n in rows) // 100)
        assert len(fill) <= least * 1.2 + 1


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, 60), (1, 60), (None, 10)], "doc_id bigint, tokens bigint")
    out = containers(df, capacity=100).collect()
    assert sorted((str(r.doc_id), r.tokens) for r in out) == [("1", 60), ("1", 60), ("None", 10)] and len({r.contenedor for r in out}) == 2
    assert containers(df.limit(0), capacity=100).count() == 0


def test_null_keys_are_spread_over_the_shards(spark):
    df = spark.createDataFrame([(None, 30)] * 2000, "doc_id bigint, tokens bigint")
    out = containers(df, capacity=100, shard_items=100).collect()
    assert len(out) == 2000 and len({r.contenedor >> 32 for r in out}) > 5
    assert max(sum(r.tokens for r in out if r.contenedor == c) for c in {r.contenedor for r in out}) <= 100
