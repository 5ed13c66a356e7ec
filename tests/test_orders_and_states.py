"""Keyed permutations, configurations, exactly-once streams, table functions, and sketches."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import schedules
from quern.operators import chunks, ordering, packing, table_functions
from quern.sources import configs, manifests, tables
from quern.sources.tables import Source
from quern.streaming import packer


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 97, 100, 1023, 4096, 10_007])
@pytest.mark.parametrize("seed", [0, 42])
def test_a_permutation_is_a_bijection_with_its_inverse(n, seed):
    p, x = ordering.Permutation(seed), np.arange(n)
    y = p.walk(x, np.full(n, n))
    assert sorted(y.tolist()) == list(range(n)) and (p.walk(y, np.full(n, n), back=True) == x).all()


def test_permutations_of_large_and_mixed_sizes_look_random():
    p = ordering.Permutation(7)
    r = np.random.default_rng(0)
    n = r.integers(1, 1 << 45, 3000)
    x = (r.random(3000) * n).astype(np.int64)
    y = p.walk(x, n)
    assert ((y >= 0) & (y < n)).all() and (p.walk(y, n, back=True) == x).all()
    n = 100_003
    y = p.walk(np.arange(n), np.full(n, n))
    assert abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.02 and abs(np.corrcoef(y[:-1], y[1:])[0, 1]) < 0.02
    assert 0.9 < np.bincount(y[:10_000] * 10 // n, minlength=10).min() / 1000 and len(np.unique(np.diff(y))) > 0.9 * len(np.unique(np.diff(r.permutation(n))))
    assert (y != ordering.Permutation(8).walk(np.arange(n), np.full(n, n))).mean() > 0.99


def test_places_of_columns(spark):
    df = spark.range(0, 53, 1, 3).withColumn("n", F.lit(51))
    rows = df.select("id", ordering.keyed_place(F.col("id"), F.col("n"), 3).alias("p"), ordering.keyed_place(F.col("id"), 51, 3).alias("q")).collect()
    assert sorted(r.p for r in rows if r.id < 51) == list(range(51)) and all(r.p == r.q for r in rows) and [r.p for r in rows if r.id >= 51] == [None, None]
    assert df.limit(0).select(ordering.keyed_place(F.col("id"), F.col("n"), 3)).collect() == []


def test_a_keyed_order_neither_sorts_nor_shuffles_windows(spark):
    shards = spark.createDataFrame([("a", 0, 95), ("a", 1, 9), ("b", 0, 1000), (None, 0, 40), ("c", 0, None)], "source string, shard int, token_count long")
    whole = manifests.keyed_order(shards, 9, 1, ["source", "shard"])
    rows = [tuple(r) for r in whole.collect()]
    assert sorted(r[0] for r in rows) == list(range(9 + 100 + 4)) and len({r[1:] for r in rows}) == len(rows)
    resumed = manifests.keyed_order(shards, 9, 1, ["source", "shard"], start=100)
    assert sorted(map(str, resumed.collect())) == sorted(str(r) for r in whole.collect() if r.pos >= 100)
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Exchange" not in above and "Sort" not in above and "Window" not in above


def test_configurations_keep_what_they_do_not_know(spark, tmp_path):
    path = f"file://{tmp_path}/c.json"
    given = {"model_config_path": "m", "datasets": [{"name": "a", "split": "train", "take_examples": 10, "unknown": 1}, "junk", {"no": "name"}], "validation_datasets": [{"name": "b", "split": "test"}], "seq_len": 2048, "lr_multipliers": [1.0, 2.5], "rope_scaling": {"factor": 2}, "new": {"deep": [1]}, "flag": True}
    configs.write_text(spark, path, json.dumps(given))
    c = configs.load(spark, path)
    assert c.sources() == [Source("a", take_examples=10)] and c.sources("validation_datasets") == [Source("b", "test")] and c.sources("absent") == []
    assert c.number("seq_len", 512) == 2048 and c.number("batch_size", 2) == 2 and c.number("flag", 3) == 3 and c.number("new", 4) == 4
    configs.save(spark, c.changed(seq_len=64, datasets=[Source("z")]), path)
    again = configs.load(spark, path)
    assert again.fields == given | {"seq_len": 64, "datasets": [{"name": "z", "split": "train", "config_name": None, "take_examples": -1, "skip_examples": 0}]}
    configs.write_text(spark, path, "[1]")
    with pytest.raises(ValueError, match="no configuration"):
        configs.load(spark, path)


def test_prompts_of_a_table(spark):
    df = spark.createDataFrame([(3, " c\n"), (1, ""), (2, None), (0, "　a "), (4, " \t")], "o int, t string")
    assert sorted(map(tuple, tables.prompts_of(df, "o", "t").collect())) == [(0, "a"), (1, "c")]


def test_stage_rates_of_columns(spark):
    ratios, widths = [2.0, 3.0, 5.0], [4, 6, 8]
    row = spark.range(1).select(*[schedules.stage_multiplier([F.lit(r) for r in ratios], [F.lit(w) for w in widths], i) for i in range(3)]).first()
    assert all(math.isclose(a, b) for a, b in zip(row, schedules.stage_multipliers(ratios, widths), strict=True))


def test_repeated_batches_leave_each_record_once(spark, tmp_path):
    ddl = "id long, v string"
    feed = lambda rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(broken=None):
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        writer = tables.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", "id")
        if broken is not None:  # a batch that fails after half of its work
            writer = writer.foreachBatch(broken)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()

    feed([(i, "a") for i in range(20)])
    run()
    feed([(i, "b") for i in range(10, 30)] + [(29, "again")])

    def half(batch, number):
        batch.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(half)
    run()
    run()
    got = tables.read_appended(spark, f"{tmp_path}/out", ddl).collect()
    assert sorted(r.id for r in got) == list(range(30)) and all(r.v == "a" for r in got if r.id < 20)


def test_streams_hold_blocks_and_survive_restarts(spark, tmp_path, monkeypatch):
    """Rows of a source come in any order and in more pieces than one; results are the batch's."""
    monkeypatch.setattr(packer, "BLOCK_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch", "7")
    try:
        ddl = "doc_id long, source string, text string"
        rows = [(i, ["hot", "hot", "b", None][i % 4], "ab" * (i % 5) + "é") for i in range(160)]
        want = sorted(((r.source, r.window, bytes(r.bytes)) for r in packing.windows(spark.createDataFrame(rows, ddl), "doc_id", "source", 11).collect()), key=repr)
        for a, b in ((0, 80), (80, 160)):
            part = rows[a:b]
            random.Random(a).shuffle(part)
            spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = packer.run_to_end(packer.pack_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), "doc_id", "source", 11), str(tmp_path), "packed")
        assert sorted(((r.source, r.window, bytes(r.bytes)) for r in out.collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch")


def test_pieces_are_merged_from_the_store():
    class Store(dict):
        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

        def getValue(self, k):  # noqa: N802
            return self[k]

        def removeKey(self, k):  # noqa: N802
            del self[k]

    p = packer.InOrder("x int", (0,), None)
    p.laid, places = Store(), random.Random(3).sample(range(10_000), 5000)
    pieces = [pd.DataFrame({"o": places[i : i + 1700], "v": [b"x" * 10] * len(places[i : i + 1700])}) for i in range(0, 5000, 1700)]
    most = 0
    for i, row in enumerate(p.in_order(iter(pieces))):
        assert row[0] == sorted(places)[i] if i in (0, 17, 4999) else True
        most = max(most, len(p.laid))
    assert i == 4999 and not p.laid and most <= 6
    assert [r[0] for r in p.in_order(iter(pieces[:1]))] == sorted(places[:1700]) and list(p.in_order(iter([]))) == []


def test_the_packer_in_sql(spark):
    table_functions.register(spark)
    rows = [(s, i, b"ab" * (i % 4)) for s in ("x", None, "y") for i in range(20)] + [("x", 99, None)]
    df = spark.createDataFrame(rows, "source string, ord int, bytes binary").repartition(3)
    got = spark.sql("select * from pack_windows(table(select * from {df}) partition by source order by (ord), 7)", df=df).collect()
    assert len(got) == 3 * (60 // 7) and all(bytes(r.bytes) == (b"ab" * 30)[r.window * 7 : r.window * 7 + 7] for r in got)


def test_quantiles_and_sketches(spark):
    r = random.Random(4)
    rows = [("hot", int(r.expovariate(0.001))) for _ in range(20_000)] + [(None, i) for i in range(10)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, n int").repartition(5)
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = {x.g: x for x in chunks.length_quantiles(df, "g", "n", shares).collect()}
    groups = {g: sorted(n for h, n in rows if h == g and n is not None) for g in ("hot", None, "one")}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert all(got[g][k] == values[max(1, len(values) - math.floor(len(values) - q * len(values))) - 1] for k, q in shares.items())
    fine = chunks.sketched(df.withColumn("part", F.col("n") % 7), ["g", "part"], "n", 200)
    merged = chunks.merged_sketches(fine, ["g"]).where("g = 'hot'").select(*[chunks.sketch_quantile(F.col("sketch"), q).alias(k) for k, q in shares.items()], F.octet_length("sketch").alias("size")).first()
    for k, q in shares.items():
        below, up_to = (sum(x < merged[k] for x in groups["hot"]) / 20_000, sum(x <= merged[k] for x in groups["hot"]) / 20_000)
        assert below <= q + chunks.sketch_error(200) and up_to >= q - chunks.sketch_error(200)
    assert merged["size"] < 10_000


def test_character_shares(spark):
    df = spark.createDataFrame([("a", "Ab 1!\n日本ｶ😀é"), ("a", None), ("b", ""), (None, "xyz")], "g string, t string")
    got = {r.g: r.asDict() for r in chunks.character_shares(df, "g", "t").collect()}
    n = 11
    assert {k: round(v * n) for k, v in got["a"].items() if k not in ("g", "bytes_per_character")} == {"space": 2, "letter": 2, "sign": 2, "japanese": 3, "emoji": 1, "other": 1}
    assert got["b"]["space"] is None and got[None]["letter"] == 1.0 and round(got["a"]["bytes_per_character"] * n) == len("Ab 1!\n日本ｶ😀é".encode())
