import json

import pytest
from pyspark.sql import functions as F

from quern.functions.text import render_chunk
from quern.operators import chunks, packing
from quern.plans import catalogue
from quern.sources import packed
from quern.streaming import packer

GOLDEN = "é日x"


def test_chunk_report_tiles_the_input(spark):
    raw = b"\xfe" + GOLDEN.encode()
    cuts = [0, 1, 2, 6]
    rows = spark.createDataFrame([(1, i, c, (cuts + [len(raw)])[i + 1], raw) for i, c in enumerate(cuts)], "seq int, chunk int, start long, end long, data binary")
    out = chunks.cut_bytes(rows, "data")
    assert b"".join(bytes(r.chunk_bytes) for r in out.orderBy("chunk").collect()) == raw
    assert chunks.chunk_report(out, "seq", "chunk", render_chunk("chunk_bytes")).first().line == "[<0xFE>], [<0xC3>], [<0xA9>日], [x]"


def test_mix_manifest(spark):
    df = spark.createDataFrame([("b", 0, 5), ("a", 3, 7)], "source string, take long, total long")
    m = json.loads(packing.mix_manifest(df, "source", "take", "total", 42).first().manifest)
    assert [d["name"] for d in m["datasets"]] == ["a", "b"] and m["datasets"][0]["weight"] == 0.75 and m["total_tokens"] == 12 and m["seed"] == 42


def test_streams_agree_with_batch_and_keep_state_between_runs(spark, tmp_path):
    rows = [(i, f"s{i % 2}", "ab" * (i % 5) + "é") for i in range(30)]
    ddl = "doc_id long, source string, text string"
    want = sorted((r.source, r.window, bytes(r.bytes)) for r in packing.windows(spark.createDataFrame(rows, ddl), "doc_id", "source", 11).collect())
    for part in (rows[:13], rows[13:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        out = packer.run_to_end(packer.pack_stream(stream, "doc_id", "source", 11), str(tmp_path), "packed")
    assert sorted((r.source, r.window, bytes(r.bytes)) for r in out.collect()) == want


def test_streaming_smoother(spark, tmp_path):
    rows = [(s, i, float(i % 4), ((i * 7 + s) % 10) / 10) for s in (0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "s int, pos long, x double, p double")
    want = {(str(r.s), r.pos): r.z for r in chunks.smoothed(df, "s", "pos", "x").collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {(r.s, r.pos): r.z for r in packer.run_to_end(packer.smooth_stream(stream, "s", "pos", "x", "p"), str(tmp_path), "z").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_packed_source_subset_and_start(spark, tmp_path):
    rows = [(s, i, bytes([s * 10 + i]) * 7) for s in range(3) for i in range(4)]
    packed.write_packed(spark.createDataFrame(rows, "shard long, ord long, bytes binary").withColumn("shard", F.col("shard")), f"{tmp_path}/p")
    every = sorted(tuple(r)[:2] for r in packed.read_packed(spark, f"{tmp_path}/p", 5).collect())
    assert every == [(s, c) for s in range(3) for c in range(5)]
    assert sorted(tuple(r)[:2] for r in packed.read_packed(spark, f"{tmp_path}/p", 5, start=7).collect()) == every[7:]
    assert {r.shard for r in packed.read_packed(spark, f"{tmp_path}/p", 5, shards="0,2").collect()} == {0, 2}


@pytest.mark.parametrize("name, table", [("stream_pack", "documents"), ("stream_decode", "conversations")])
def test_streams_of_tables_in_folders(spark, tmp_path, name, table):
    """A table may be one file or a folder of files."""
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    want, got = (sorted(map(tuple, catalogue.QUERIES[name](spark, x).collect())) for x in (sf, str(tmp_path)))
    assert want and got == want
