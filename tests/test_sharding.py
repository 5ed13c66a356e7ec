"""Greedy shards against the fold row by row."""

import random

import pytest

from quern.operators import sharding


def plain(rows, capacity):
    out, state = {}, {}
    for s, o, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        shard, used = state.get(s, (0, 0))
        if used > 0 and used + n > capacity:
            shard, used = shard + 1, 0
        state[s] = shard, used + n
        out[s, o] = shard
    return out


def table(sizes):
    r = random.Random(6)
    rows = [("hot", o, r.choice(sizes)) for o in r.sample(range(3000), 700)]
    return rows + [(s, o, r.choice(sizes)) for s in ("a", None) for o in r.sample(range(3000), 90)] + [("one", 5, 1000), ("two", 1, 0), ("two", 2, 1000), ("two", 3, 1)]


@pytest.mark.parametrize("walked", [sharding.WALKED, 0])
@pytest.mark.parametrize("sizes, capacity", [([3], 100), ([0, 0, 1, 5, 40, 300], 100), ([1, 2, 3], 10_000), ([0], 5), ([500], 100), ([7, 60], 100)])
def test_as_the_fold(spark, monkeypatch, walked, sizes, capacity):
    monkeypatch.setattr(sharding, "WALKED", walked)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        rows = table(sizes)
        df = spark.createDataFrame(rows, "s string, o int, n int").repartition(3)
        got = sharding.greedy_shards(df, "o", "s", capacity)
        assert got.columns == ["s", "o", "n", "shard"]
        assert {(r.s, r.o): r.shard for r in got.collect()} == plain(rows, capacity)
        assert sharding.greedy_shards(df.limit(0), "o", "s", capacity).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_what_a_range_hands_on_does_not_grow_with_the_capacity(spark):
    """A row for each row, of constant size, and entries only where exits lead."""
    rows = [("s", o, 1) for o in range(2000)]
    placed = spark.createDataFrame([(s, o, n, o, o // 500) for s, o, n in rows], "s string, _at long, _n long, _start long, _b int")
    for capacity in (3, 400):
        to = {r._at: r._to for r in sharding.pointers(placed, "s", capacity).collect()}
        assert to == {i: i + capacity if i + capacity < 2000 else None for i in range(2000)}
    ways = sharding.pointers(placed, "s", 400).repartition("s", "_b").sortWithinPartitions("s", "_b", "_at").mapInPandas(sharding._exits("s"), "s string, _b int, _at long, _exit long, _hops long").collect()
    assert len(ways) == 2000 and all(w._exit is None or w._exit // 500 > w._at // 500 for w in ways)
    assert {w._at: (w._exit, w._hops) for w in ways if w._at in (0, 450, 1900)} == {0: (800, 2), 450: (850, 1), 1900: (None, 1)}
