"""Shared plumbing: written tables that cut lineage, and batches of whole documents."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.sources.shared import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder. Each cuts lineage and survives lost executors.

    ``keep`` writes a frame and returns its reread form; ``drop`` removes tables whose work is done.
    What a lazy result still reads stays until the session ends. The shuffle files of a write go with it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _run(self, write: Callable[[], None]) -> None:
        conf = self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            write()
        finally:
            conf.set(_CLEANUP, before)
        self._fs.deleteOnExit(self._path(self.root))

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df, a folder for each value of the column ``by`` if given (``name/by=value`` can be dropped)."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        self._run(lambda: (writer.partitionBy(by) if by else writer).parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def bucketed(self, df: DataFrame, name: str, by: str | None, key: str, parts: int) -> Iterator[DataFrame]:
        """Writes df by ``by`` (if given) and in buckets of ``key``, so that grouping by ``key`` moves none of it.

        Buckets need an entry in the catalogue, so the table lasts only within the ``with`` block, where its work is done.
        """
        entry = f"quern_{uuid.uuid4().hex}"
        writer = (df.write.partitionBy(by) if by else df.write).bucketBy(parts, key).option("compression", "zstd").option("path", f"{self.root}/{name}")
        try:
            self._run(lambda: writer.saveAsTable(entry))
            yield self.spark.table(entry)
        finally:
            self.spark.sql(f"drop table if exists {entry}")
            self.drop(name)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def with_defaults(df: DataFrame, spark: SparkSession) -> int:
    """Partitions for a keyed exchange of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def batches(rows: Iterator[tuple[tuple, bytes]], most: int) -> Iterator[list[tuple[tuple, bytes]]]:
    """Groups (key, bytes) items into lists of about ``most`` bytes; an item alone may be larger."""
    out, size = [], 0
    for key, data in rows:
        if out and size + len(data) > most:
            yield out
            out, size = [], 0
        out.append((key, data))
        size += len(data)
    if out:
        yield out


def file_bytes(path: str) -> bytes:
    """A small file of the driver (a vocabulary), to be shipped to the executors, which need not have it."""
    with open(path, "rb") as f:
        return f.read()


#: Hashes below 2 ** 40 stand for shares of a table: fine enough for any number of rows.
PLACES = 2**40


def below(most: float, total: int) -> int:
    """Hashes of PLACES below this leave about ``most`` of ``total`` rows: some, however many rows there are."""
    return math.ceil(PLACES * min(1.0, most / max(1, total)))


def arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
