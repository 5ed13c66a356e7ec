"""Pushed filters, single windows by an index, and packed shards as a stream."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNull, LessThan, LessThanOrEqual

from quern.sources import manifests, packed

STRIDE = 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packed") / "p")
    write(spark, path, range(5))
    return path


def write(spark, path, shards, windows=400):
    rows = [(s, i, bytes([s, i % 251]) * 50) for s in shards for i in range(windows)]
    packed.write_packed(spark.createDataFrame(rows, "shard long, ord long, bytes binary"), path)


def window(s, i):
    return bytes([s, i % 251]) * 50


@pytest.mark.parametrize("where, keep", [("shard = 3", lambda s, i: s == 3), ("shard in (1, 4) and chunk >= 395", lambda s, i: s in (1, 4) and i >= 395), ("chunk in (7, 8, 399, 1000)", lambda s, i: i in (7, 8, 399)), ("chunk > 3 and chunk <= 5 and shard < 2", lambda s, i: 3 < i <= 5 and s < 2), ("shard = 9", lambda s, i: False), ("chunk % 100 = 0 or shard = 0 and chunk = 5", lambda s, i: i % 100 == 0 or (s, i) == (0, 5))])
def test_filters(spark, folder, where, keep):
    df = packed.read_packed(spark, folder, STRIDE, splitBytes=7 * STRIDE).where(where)
    want = {(s, i): window(s, i) for s in range(5) for i in range(400) if keep(s, i)}
    rows = df.collect()
    assert len(rows) == len(want) and {(r.shard, r.chunk): bytes(r.bytes) for r in rows} == want


def test_only_what_filters_leave_becomes_partitions(folder):
    reader = packed.PackedReader({"path": folder, "stride": str(STRIDE), "splitBytes": str(10 * STRIDE)})
    left = list(reader.pushFilters([In(("shard",), (1, 2)), GreaterThanOrEqual(("chunk",), 375), IsNull(("chunk",)), EqualTo(("bytes",), b"")]))
    assert left == [IsNull(("chunk",)), EqualTo(("bytes",), b"")]
    found = reader.partitions()
    assert [(p.number, p.runs) for p in found] == [(s, [(a, min(a + 10, 400))]) for s in (1, 2) for a in (375, 385, 395)]
    span = packed.Span()
    assert all(span.narrow(f) for f in (GreaterThan(("x",), 2), LessThan(("x",), 9), LessThanOrEqual(("x",), 7), In(("x",), (4, 5, 6, 7, 8)), In(("x",), (5, 6, 1))))
    assert span.runs(100) == [(5, 7)] and 5 in span and 4 not in span and 8 not in span


def test_an_index_reads_what_it_asks_for(spark, folder):
    r = random.Random(1)
    asked = r.sample([(s, i) for s in range(5) for i in range(400)], 20)
    rows = [(k, *x, "extra") for k, x in enumerate(asked)] + [(90, *asked[0], "again"), (91, 2, 400, "not there"), (92, -1, 3, "nor this"), (93, None, 3, "nor that")]
    index = spark.createDataFrame(rows, "pos long, shard long, chunk long, more string").repartition(4)
    seen = spark.sparkContext.accumulator(0)
    got = packed.samples(spark, folder, index, STRIDE, seen=seen, gap=0).collect()
    assert {(x.pos, x.more): bytes(x.bytes) for x in got} == {(p, m): window(s, i) for p, s, i, m in rows if p < 91}
    assert seen.value == STRIDE * len(set(asked))  # a hundredth of the windows, a hundredth of the bytes
    assert {x.pos for x in packed.samples(spark, folder, index, STRIDE, start=15).collect()} == {15, 16, 17, 18, 19, 90}
    plan = packed.samples(spark, folder, index, STRIDE)._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(shard") == 1


def test_runs():
    assert packed.joined([1, 2, 2, 3, 9, 11], 1) == [(1, 4), (9, 12)]
    assert packed.joined([1, 2, 3, 4, 5], 0, most=2) == [(1, 3), (3, 5), (5, 6)]
    assert list(packed._pieces([(0, 5), (8, 9)], 4)) == [[(0, 4)], [(4, 5), (8, 9)]]


def test_a_stream_goes_on_within_a_shard(spark, tmp_path):
    """A query that fails between two places of a shard goes on there: each window is there once."""
    path, out, state = (str(tmp_path / x) for x in ("p", "out", "state"))
    write(spark, path, [0, 1], windows=10)

    def start(fail_at=None):
        def sink(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if number == fail_at:
                raise RuntimeError("lost")

        return packed.stream_packed(spark, path, STRIDE, maxWindows=4).writeStream.foreachBatch(sink).option("checkpointLocation", state).start()

    query = start(fail_at=2)
    try:
        query.processAllAvailable()
        write(spark, path, [2], windows=10)
        with pytest.raises(Exception, match="lost"):
            query.processAllAvailable()
            query.awaitTermination(60)
    finally:
        query.stop()
    query = start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.shard, r.chunk, bytes(r.bytes)) for r in rows) == [(s, i, window(s, i)) for s in (0, 1, 2) for i in range(10)]
    by = {b: sorted(r.chunk for r in rows if r.batch == b and r.shard == 2) for b in (1, 2)}
    assert by[1] == [0, 1, 2, 3] and by[2][:1] == [4]


def test_a_stream_stopped_within_a_shard(folder):
    """The reader alone: offsets end within shards, and a new reader goes on from the last of them."""
    options = {"path": folder, "stride": str(STRIDE), "maxWindows": "150"}
    reader, at, got = packed.PackedStreamReader(options), None, []
    at = reader.initialOffset()
    for _ in range(4):
        end = reader.latestOffset()
        got += [(p.number, a, b) for p in reader.partitions(at, end) for a, b in p.runs]
        at = end
    assert at == {"shard": 1, "window": 200} and sum(b - a for _, a, b in got) == 600
    fresh = packed.PackedStreamReader(options)
    end = fresh.latestOffset()
    rest = [(p.number, a, b) for p in fresh.partitions(at, end) for a, b in p.runs]
    assert end == {"shard": 4, "window": 400} and rest[0] == (1, 200, 400) and sum(b - a for _, a, b in rest) == 1400
    assert fresh.partitions(end, fresh.latestOffset()) == []


class Counted(DataSource):
    """Shards that note each reading in a file."""

    @classmethod
    def name(cls):
        return "counted"

    def schema(self):
        return "shard long, token_count long"

    def reader(self, schema):
        log = self.options["log"]

        class Reader(DataSourceReader):
            def read(self, partition):
                with open(log, "a") as f:
                    f.write("read\n")
                return iter([(s, 1000) for s in range(60)])

        return Reader()


@pytest.mark.parametrize("order", [manifests.sample_order, manifests.keyed_order])
def test_an_order_reads_its_shards_once(spark, tmp_path, order):
    """Spark reads a Python data source anew for each use of it in a plan; two readings may end up with different ranges, and so with wrong positions."""
    spark.dataSource.register(Counted)
    log = tmp_path / "log"
    found = order(spark.read.format("counted").option("log", str(log)).load(), 9, 1, ["shard"])
    assert sorted(r.pos for r in found.collect()) == list(range(6000))
    assert log.read_text() == "read\n"


def test_many_small_shards_are_few_partitions(spark, tmp_path):
    path = str(tmp_path / "small")
    write(spark, path, range(200), windows=3)
    options = {"path": path, "stride": str(STRIDE)}
    found = packed.PackedReader(options).partitions()
    assert len(found) == 1 and [s for p in found for s, _ in p.shards()] == list(range(200))
    stream = packed.PackedStreamReader(options)
    assert len(stream.partitions(stream.initialOffset(), stream.latestOffset())) == 1
    assert len(packed.PackedReader(options | {"documents": "true"}).partitions()) == 1
    want = {(s, i): window(s, i) for s in range(200) for i in range(3)}
    assert {(r.shard, r.chunk): bytes(r.bytes) for r in packed.read_packed(spark, path, STRIDE).collect()} == want
    assert {(r.shard, r.chunk): bytes(r.bytes) for r in packed.read_packed(spark, path, STRIDE, documents="true").collect()} == want
    assert {r.shard for r in packed.read_packed(spark, path, STRIDE, shards="3::50,7").collect()} == {3, 7, 53, 103, 153}
