"""Table functions for SQL: whole partitions of a table in order, row by row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class PackWindows:
    """``pack_windows(TABLE(SELECT source, ord, bytes ...) PARTITION BY source ORDER BY (ord), stride)``: the stream of each partition cut every
    ``stride`` bytes as (source, window, bytes); the short tail is dropped.

    A partition is one task, which holds one row and less than a window of what came before; ``packing.windows`` also splits a hot source.
    """

    def __init__(self):
        self.rest, self.window = b"", 0

    def eval(self, row: Row, stride: int) -> Iterator[tuple]:
        if row[2] is None:
            return
        data = self.rest + bytes(row[2])
        full = len(data) // stride
        for i in range(full):
            yield row[0], self.window + i, data[i * stride : (i + 1) * stride]
        self.rest, self.window = data[full * stride :], self.window + full


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("pack_windows", F.udtf(PackWindows, returnType="source string, window long, bytes binary"))
