"""Packed shards as a data source: raw byte streams (.bin) with document offsets (.idx).

``spark.read.format("packed")`` yields (shard, chunk, bytes), complete windows only. Filters on shard and chunk are pushed down: only the
byte ranges of the windows that they leave are read, in input partitions of at most ``splitBytes`` each, so a large shard is read by many tasks
and many small ones by one. Option ``shards`` takes a comma-separated subset, in which ``a::k`` is every k-th number from a on, ``start`` skips windows of the whole, ``documents`` yields
the documents of each shard (chunk is then a document's place) as their offsets say. ``spark.readStream`` yields each window once, shard by shard;
its offset is a place (shard, window), so that a restart goes on inside a shard. ``df.write.format("packed")`` takes
(shard, ord, bytes) rows of one shard per partition. Files are written under temporary names and moved into place
when the whole write commits, so a retried or speculative task harms nothing; mode overwrite removes what was there.

``samples`` looks up single windows by an index: each task reads the ranges that its part of the index asks for, and no more.

Paths may be plain, file:// or any URI that pyarrow's file systems open; executors must see the same folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

#: OPEN: what opening a shard weighs in bytes read, when input partitions are dealt out. MOVERS: files that a commit moves at once.
SPLIT, BLOCK, GAP, OPEN, MOVERS = 64 << 20, 8 << 20, 64 << 10, 256 << 10, 16
_SCHEMA = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("bytes", pa.binary())])


def _open(path: str):
    """(file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _sizes(fs, folder: str) -> dict[str, int]:
    from pyarrow.fs import FileSelector

    return {i.base_name: i.size for i in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if i.is_file}


def _shards(path: str) -> dict[int, int]:
    """Bytes by shard number, in order."""
    found = _sizes(*_open(path))
    return {int(name[5:-4]): found[name] for name in sorted(found) if name.endswith(".bin")}


@dataclass
class Shard(InputPartition):
    """Windows [first, last) in runs, each of the shard that ``numbers`` has in its place; for documents, whole shards."""

    folder: str
    numbers: list[int]
    runs: list[tuple[int, int]]

    @property
    def number(self) -> int:
        return self.numbers[0]

    def shards(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(number, its runs)"""
        for number, both in groupby(zip(self.numbers, self.runs, strict=True), key=lambda x: x[0]):
            yield number, [run for _, run in both]


@dataclass
class Span:
    """Whole numbers that filters leave: low <= x < high, and among ``only`` if given."""

    low: int = 0
    high: int | None = None
    only: set[int] | None = None
    steps: tuple[range, ...] | None = None

    def narrow(self, f: Filter) -> bool:
        """Takes a filter in; false for one that it cannot express."""
        v = getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, v + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(v + isinstance(f, LessThanOrEqual), v + 1 if self.high is None else self.high)
        else:
            return False
        return True

    def runs(self, n: int) -> list[tuple[int, int]]:
        """What is left of 0..n-1, in runs."""
        low, high = self.low, n if self.high is None else min(n, self.high)
        if self.only is None:
            return [(low, high)] if low < high else []
        return joined(sorted(x for x in self.only if x is not None and low <= x < high), 0)

    def __contains__(self, x: int) -> bool:
        return x >= self.low and (self.high is None or x < self.high) and (self.only is None or x in self.only) and (self.steps is None or any(x in r for r in self.steps))


def joined(places: Iterable[int], gap: int, most: int | None = None) -> list[tuple[int, int]]:
    """Ascending places as runs [first, last), across gaps of at most ``gap`` places, each of at most ``most`` places."""
    out: list[tuple[int, int]] = []
    for x in places:
        if out and x - out[-1][1] <= gap and (most is None or x + 1 - out[-1][0] <= most):
            out[-1] = out[-1][0], max(x + 1, out[-1][1])
        else:
            out.append((x, x + 1))
    return out


def _pieces(runs: list[tuple[int, int]], most: int) -> Iterator[list[tuple[int, int]]]:
    """The runs dealt out over lists of at most ``most`` windows."""
    out, size = [], 0
    for first, last in runs:
        while first < last:
            n = min(last - first, most - size)
            out.append((first, first + n))
            first, size = first + n, size + n
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def _dealt(folder: str, pieces: Iterable[tuple[int, list[tuple[int, int]], int]], most: int) -> list[Shard]:
    """(shard, runs, bytes) in input partitions of at most ``most`` bytes, unless a piece alone has more: their number follows the bytes, not the shards."""
    out: list[Shard] = []
    size = most
    for number, runs, n in pieces:
        size += n + OPEN
        if size > most:
            out.append(Shard(folder, [], []))
            size = n + OPEN
        out[-1].numbers.extend([number] * len(runs))
        out[-1].runs.extend(runs)
    return out


def _read_runs(fs, folder: str, number: int, runs: list[tuple[int, int]], stride: int) -> Iterator[tuple[int, bytes]]:
    """(first window, bytes of some whole windows) of a shard's runs, block by block."""
    most = max(1, BLOCK // stride)
    with fs.open_input_file(f"{folder}/data-{number:05d}.bin") as f:
        for first, last in runs:
            while first < last:
                n = min(most, last - first)
                data = f.read_at(n * stride, first * stride)
                whole = len(data) // stride
                if whole:
                    yield first, data[: whole * stride]
                first += n


def _batches(read: Iterator[tuple[int, int, np.ndarray, bytes]]) -> Iterator[pa.RecordBatch]:
    """(shard, first chunk, sizes of the chunks, their bytes) as batches of about a block, across shards."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        numbers, firsts, sizes, data = zip(*held, strict=True)
        counts = [len(x) for x in sizes]
        ends = pa.py_buffer(np.concatenate([[0], *sizes]).cumsum().astype(np.int32))
        bytes_ = pa.Array.from_buffers(pa.binary(), sum(counts), [None, ends, pa.py_buffer(data[0] if len(data) == 1 else b"".join(data))])
        chunks = np.concatenate([np.arange(a, a + n, dtype=np.int64) for a, n in zip(firsts, counts, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(numbers, np.int64), counts)), pa.array(chunks), bytes_], schema=_SCHEMA)

    for item in read:
        if held and size + len(item[3]) > BLOCK:
            yield batch()
            held, size = [], 0
        held.append(item)
        size += len(item[3])
    if held:
        yield batch()


def _windows(partition: Shard, stride: int) -> Iterator[pa.RecordBatch]:
    fs, folder = _open(partition.folder)
    blocks = ((number, first, data) for number, runs in partition.shards() for first, data in _read_runs(fs, folder, number, runs, stride))
    return _batches((number, first, np.full(len(data) // stride, stride), data) for number, first, data in blocks)


@dataclass
class Written(WriterCommitMessage):
    """The shards that a task wrote, and where."""

    folder: str
    numbers: list[int]


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.stride, self.start = options["path"], int(options.get("stride", 513)), int(options.get("start", 0))
        self.split = max(self.stride, int(options.get("splitBytes", SPLIT)))
        self.shard, self.chunk = Span(), Span()
        if options.get("shards"):
            named = [x.split("::") for x in options["shards"].split(",")]
            self.shard.steps = tuple(range(int(x[0]), 1 << 62, int(x[1])) if len(x) == 2 else range(int(x[0]), int(x[0]) + 1) for x in named)
        self.documents = str(options.get("documents", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", ())
            span = self.shard if name == ("shard",) else self.chunk if name == ("chunk",) and not self.documents else None
            if span is None or not span.narrow(f):
                yield f

    def partitions(self) -> list[Shard]:
        return _dealt(self.folder, self._asked(), self.split) or [Shard(self.folder, [], [])]  # Spark wants a partition

    def _asked(self) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
        skip = self.start
        for number, size in _shards(self.folder).items():
            if number not in self.shard:
                continue
            if self.documents:
                yield number, [(0, 0)], size
                continue
            windows = size // self.stride
            runs = [(max(a, skip), b) for a, b in self.chunk.runs(windows) if b > skip]
            for r in _pieces(runs, self.split // self.stride):
                yield number, r, sum(b - a for a, b in r) * self.stride
            skip = max(0, skip - windows)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _batches(self._whole_documents(partition)) if self.documents else _windows(partition, self.stride)

    def _whole_documents(self, partition: Shard) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
        fs, folder = _open(partition.folder)
        for number in partition.numbers:
            name = f"{folder}/data-{number:05d}"
            with fs.open_input_file(f"{name}.bin") as f, fs.open_input_file(f"{name}.idx") as i:
                ends = np.frombuffer(i.read(), "<u8").astype(np.int64)
                if not len(ends) or ends[0] != 0 or ends[-1] != f.size() or (np.diff(ends) < 0).any():
                    raise ValueError(f"offsets of shard {number} do not fit its bytes")
                k = 0
                while k < len(ends) - 1:  # as many as fit a block, one at least
                    last = max(k + 1, int(np.searchsorted(ends, ends[k] + BLOCK, "right")) - 1)
                    yield number, k, np.diff(ends[k : last + 1]), f.read(int(ends[last] - ends[k]))
                    k = last


class PackedStreamReader(DataSourceStreamReader):
    """Windows in the order of shards; shards come whole and with rising numbers, as ``write_packed`` commits them.

    An offset is the first window not yet read. ``maxWindows`` bounds each batch but the first after a start, when Spark does not tell where the
    query stands.
    """

    def __init__(self, options):
        self.folder, self.stride = options["path"], int(options.get("stride", 513))
        self.split, self.most = max(self.stride, int(options.get("splitBytes", SPLIT))), int(options.get("maxWindows", 0))
        self.at: tuple[int, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = (0, 0)
        return {"shard": 0, "window": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        left = self.most if self.at is not None else 0
        shard, window = self.at or (0, 0)
        for number, size in _shards(self.folder).items():
            windows = size // self.stride
            if number < shard:
                continue
            first = window if number == shard else 0
            shard, window = number, windows
            if self.most and self.at is not None:
                if windows - first >= left:
                    window = first + left
                    break
                left -= windows - first
        return {"shard": shard, "window": window}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        (a, first), (b, last) = ((x["shard"], x["window"]) for x in (start, end))
        self.at = (b, last)

        def asked():
            for number, size in _shards(self.folder).items():
                if a <= number <= b:
                    run = (first if number == a else 0, last if number == b else size // self.stride)
                    for r in _pieces([run] if run[0] < run[1] else [], self.split // self.stride):
                        yield number, r, sum(y - x for x, y in r) * self.stride

        return _dealt(self.folder, asked(), self.split)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _windows(partition, self.stride)

    def commit(self, end: dict) -> None:
        """The files stay."""


class PackedWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        fs, folder = _open(self.folder)
        temporary = f"{folder}/_temporary-{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(temporary, recursive=True)
        numbers: list[int] = []
        now, out, ends = None, None, []

        def close():
            if out is not None:
                out.close()
                with fs.open_output_stream(f"{temporary}/data-{now:05d}.idx") as f:
                    f.write(np.array(ends, "<u8").tobytes())
                numbers.append(now)

        for row in iterator:
            if row["shard"] != now:
                close()
                now, ends = row["shard"], [0]
                out = fs.open_output_stream(f"{temporary}/data-{now:05d}.bin")
            out.write(bytes(row["bytes"]))
            ends.append(ends[-1] + len(row["bytes"]))
        close()
        return Written(temporary, numbers)

    def commit(self, messages) -> None:
        fs, folder = _open(self.folder)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for name in _sizes(fs, folder):
                if name.endswith((".bin", ".idx")):
                    fs.delete_file(f"{folder}/{name}")
        moves = ((f"{m.folder}/{name}", f"{folder}/{name}") for m in messages if m for n in m.numbers for name in (f"data-{n:05d}.bin", f"data-{n:05d}.idx"))
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(lambda pair: fs.move(*pair), moves):
                pass
        self._clear(fs, folder)

    def abort(self, messages) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, fs, folder: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{folder}/_temporary-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{folder}/_temporary-{self.job}")


class Packed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "shard long, chunk long, bytes binary"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)

    def streamReader(self, schema) -> PackedStreamReader:  # noqa: N802
        return PackedStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)


def write_packed(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """rows(shard, ord, bytes), written as one pair of files per shard."""
    rows.sparkSession.dataSource.register(Packed)
    placed = rows.repartition("shard").sortWithinPartitions("shard", "ord").select("shard", "ord", "bytes")
    placed.write.format("packed").mode("overwrite" if overwrite else "append").save(folder)


def _with_options(reader, stride: int, options: dict):
    reader = reader.format("packed").option("stride", stride)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader


def read_packed(spark, folder: str, stride: int, **options) -> DataFrame:
    """The windows of a folder; from here on the session pushes filters down to Python data sources."""
    spark.dataSource.register(Packed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _with_options(spark.read, stride, options).load(folder)


def stream_packed(spark, folder: str, stride: int, **options) -> DataFrame:
    """The windows of a folder as a stream, those of shards that come later included."""
    spark.dataSource.register(Packed)
    return _with_options(spark.readStream, stride, options).load(folder)


def _fetch(folder: str, stride: int, gap: int, schema: pa.Schema, seen: Accumulator | None) -> Callable:
    """Index rows, sorted by shard and chunk -> the same with the bytes of their windows; rows without a whole window go."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in it:
            shard, chunk = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "chunk"))
            bytes_: list[bytes | None] = [None] * len(chunk)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                at = a
                # Neighbours within ``gap`` bytes come by one read.
                runs = joined(chunk[a:b].tolist(), gap // stride, max(1, BLOCK // stride))
                for first, data in _read_runs(fs, path, int(shard[a]), runs, stride):
                    if seen is not None:
                        seen.add(len(data))
                    n = len(data) // stride
                    while at < b and chunk[at] < first + n:
                        place = int(chunk[at] - first) * stride
                        bytes_[at] = data[place : place + stride]
                        at += 1
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(bytes_, pa.binary())], schema=schema)
            yield out.filter(out.column(out.num_columns - 1).is_valid())

    return run


def samples(spark, folder: str, index: DataFrame, stride: int, start: int = 0, seen: Accumulator | None = None, gap: int = GAP) -> DataFrame:
    """index(pos, shard, chunk, ...) with the bytes of each sample; positions below ``start`` are left out (resume).

    Only the index is shuffled, sorted by shard and stretch of it; then each task reads the ranges that it needs, so a hundredth of an index
    reads about a hundredth of the bytes. Windows that are not there are left out. ``seen`` counts the bytes read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = (index.where(F.col("pos") >= start) if start > 0 else index).where("shard >= 0 and chunk >= 0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    stretch = F.floor(F.col("chunk") * stride / F.lit(SPLIT))
    laid = wanted.repartition(parts, "shard", stretch).sortWithinPartitions("shard", "chunk")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    schema = pa.schema([*to_arrow_schema(laid.schema), ("bytes", pa.binary())])
    return laid.mapInArrow(_fetch(folder, stride, gap, schema, seen), f"{fields}, bytes binary")
