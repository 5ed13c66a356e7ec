"""Windows in ranges against plain windows, and packing and de-duplication of rows that repeat."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import chunks, mixing, ordering, packing, ranged


@pytest.fixture(params=[1, 4, 50])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def sequences(spark):
    """A sequence with two thirds of the rows, short ones, one of a row, and one without a name."""
    r = random.Random(5)
    rows = [("hot", p, r.choice([None, 1, 2, 7]), r.random() < 0.2) for p in r.sample(range(5000), 400)]
    rows += [(s, p, r.choice([None, 3]), r.random() < 0.5) for s in ("a", "b", None) for p in r.sample(range(300), 60)] + [("one", 9, 4, True)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "seq string, pos int, v int, b boolean").repartition(3)


def test_each_function_as_a_plain_window(spark, parts):
    df = sequences(spark)
    w = Window.partitionBy("seq").orderBy("pos")
    before, up_to, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    v = F.col("v")
    want = df.select("seq", "pos", "v", "b", F.lag("v").over(w).alias("g"), F.lead("v").over(w).alias("d"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("t"), F.coalesce(F.sum("v").over(up_to), F.lit(0)).alias("i"), F.last("v", True).over(up_to).alias("l"), F.first("v", True).over(after).alias("f"))
    got = ranged.windowed(df, ["seq"], F.col("pos"), g=ranged.lag(v), d=ranged.lead(v), t=ranged.total(v), i=ranged.total(v, True), l=ranged.latest(v), f=ranged.following(v))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hot_sequence_is_dealt_out(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    df = ranged.laid(sequences(spark), ["seq"], F.col("pos"))
    sizes = df.groupBy("_rg").count().where("_rg.seq = 'hot'").agg(F.max("count"), F.count("*")).first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[1] >= 20 and sizes[0] <= 2 * 581 / 40


def test_calls_on_a_laid_frame_share_its_exchange(spark):
    df = ranged.laid(sequences(spark), ["seq"], F.col("pos"))
    once = ranged.windowed(df, ["seq"], F.col("pos"), g=ranged.lag(F.col("v")))
    twice = ranged.windowed(once, ["seq"], F.col("pos"), d=ranged.lead(F.col("g")))
    assert {"_rg", "_rk"} <= set(twice.columns)
    plain = Window.partitionBy("seq").orderBy("pos")
    want = sequences(spark).withColumn("g", F.lag("v").over(plain)).withColumn("d", F.lead("g").over(plain))
    assert sorted(map(tuple, twice.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_orders_of_several_columns(spark, parts):
    rows = [("x", i % 7 / 7, i) for i in range(90)] + [("y", 0.5, i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, p double, tie int").repartition(3)
    want = {}
    for g in "xy":
        before = 0.0
        for _, p, tie in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])):
            if before <= 9:
                want[g, tie] = p
            before += p
    assert {(r.g, r.tie): r.p for r in chunks.nucleus(df, "g", "p", "tie", 9.0).collect()} == want


def test_empty_frames(spark, parts):
    df = sequences(spark).limit(0).withColumnRenamed("b", "is_boundary")
    assert chunks.as_of(df, "seq", "pos", F.col("v"), "x").collect() == []
    assert chunks.chunks(df, "seq", "pos", F.lit(5)).collect() == []


def plain_windows(rows, stride):
    out = {}
    for source in {r[1] for r in rows}:
        stream = b"".join(b"\xfe" + t.encode() + b"\xff" for t in (t for _, _, t in sorted(((d is not None, d or 0), s, t) for d, s, t in rows if s == source)) if t)
        for i in range(len(stream) // stride):
            out[source, i] = stream[i * stride : (i + 1) * stride]
    return out


@pytest.mark.parametrize("case", ["repeated", "null source", "shared order", "all"])
def test_windows_keep_every_row(spark, parts, case):
    rows = [(i, "s", "t" * (i % 9) + "é") for i in range(40)]
    if case in ("repeated", "all"):
        rows += rows[:15] + rows[:3]
    if case in ("null source", "all"):
        rows += [(i, None, "u" * 11) for i in range(9)]
    if case in ("shared order", "all"):
        rows += [(i, "s", f"x{i}") for i in range(10)] + [(None, "s", "no place"), (None, "q", None)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").repartition(3)
    want = plain_windows([(d, s, t) for d, s, t in rows], 11)
    assert {(r.source, r.window): bytes(r.bytes) for r in packing.windows(df, "doc_id", "source", 11).collect()} == want


def test_first_of_keeps_one_row_of_each_key(spark, parts):
    rows = [(5, "x", 1), (3, "y", 2), (5, "y", 3), (3, "z", 4), (3, "z", 4), (3, "z", 5), (None, "w", 6), (7, None, 7), (2, None, 8), (1, "v", 9), (1, "v", 9)]
    df = spark.createDataFrame(rows, "d int, k string, v int").repartition(3)
    got = mixing.first_of(df, ["k"], "d")
    assert got.columns == ["d", "k", "v"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert [r for r in got if r[1] != "z"] == sorted([(5, "x", 1), (3, "y", 2), (None, "w", 6), (2, None, 8), (1, "v", 9)], key=repr)
    assert [r[:2] for r in got if r[1] == "z"] == [(3, "z")]
    assert sorted(r.k for r in mixing.first_of(df, [F.upper("k")], "d", F.col("k").isNotNull()).collect()) == ["v", "w", "x", "y", "z"]
    again = mixing.first_of(df.repartition(5), ["k"], "d").collect()
    assert sorted(map(tuple, again), key=repr) == got


def test_running_sums_with_nulls_and_ties(spark, parts):
    rows = [(g, o, n) for g in ("a", None) for o in (None, 1, 1, 2, 8) for n in (1, 2)]
    df = spark.createDataFrame(rows, "g string, o int, n int").repartition(4)
    got = ordering.running(df, "o", "n", "s", ["g"], [F.col("n")]).collect()
    for g in ("a", None):
        before = 0
        mine = sorted((r.s, r.o, r.n) for r in got if r.g == g and r.o is not None) + []
        nulls = sorted((r.s, r.n) for r in got if r.g == g and r.o is None)
        for s, n in nulls:
            assert s == before
            before += n
        for s, _, n in mine:
            assert s == before
            before += n
        assert [(o, n) for _, o, n in mine] == sorted((o, n) for h, o, n in rows if h == g and o is not None)
