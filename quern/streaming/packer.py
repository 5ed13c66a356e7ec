"""Streaming packer, smoother and decoder: the state of a source is what its last batch left over.

Each is a fold over a source's rows in order. A micro-batch hands its rows over piece by piece, in any order: pieces are sorted by themselves, laid in the
state store in blocks, and merged from there, so that a task holds a block of each piece and never a source's whole batch.
"""

from __future__ import annotations

import codecs
import heapq
import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.packing import framed

#: Rows and bytes of a block in the state store, and rows of a frame that goes out.
BLOCK_ROWS, BLOCK_BYTES, OUT_ROWS = 1000, 1 << 20, 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _blocks(rows: list[tuple]) -> Iterator[list[tuple]]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(out) >= BLOCK_ROWS or size >= BLOCK_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


class InOrder(StatefulProcessor):
    """Folds the rows of a key, the first of whose columns is their order, with a state that outlives the batch.

    ``fold(key, rows, state)`` yields frames and returns the new state.
    """

    def __init__(self, state: str, start: tuple, fold: Callable):
        self.kind, self.start, self.fold = state, start, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kind)
        self.laid = handle.getMapState("laid", "piece int, block int", "rows binary")

    def _lay(self, piece: int, rows: list[tuple]) -> int:
        n = 0
        for n, block in enumerate(_blocks(rows), 1):
            self.laid.updateValue((piece, n - 1), (pickle.dumps(block),))
        return n

    def _taken(self, piece: int, blocks: int) -> Iterator[tuple]:
        for b in range(blocks):
            rows = pickle.loads(self.laid.getValue((piece, b))[0])
            self.laid.removeKey((piece, b))
            yield from rows

    def in_order(self, pieces: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        sort = lambda pdf: sorted(pdf.itertuples(index=False, name=None), key=lambda r: r[0])
        first = next(pieces, None)
        if first is None:
            return
        second = next(pieces, None)
        if second is None:
            yield from sort(first)
            return
        counts = [self._lay(i, sort(pdf)) for i, pdf in enumerate(chain((first, second), pieces))]
        yield from heapq.merge(*[self._taken(i, n) for i, n in enumerate(counts)], key=lambda r: r[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else self.start
        state = yield from self.fold(key[0], self.in_order(iter(rows)), state)
        self.state.update(state)

    def close(self) -> None:
        """Nothing is open."""


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _folded(slim: DataFrame, by: str, out: str, state: str, start: tuple, step: Callable) -> DataFrame:
    """slim(by, order, ...) -> rows of ``out``; step(key, row, state) returns (rows, new state)."""
    spark = slim.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKS:  # the only store that knows states of several kinds
        spark.conf.set(_PROVIDER, _ROCKS)
    columns = [f.split()[0] for f in out.split(", ")]

    def fold(key, rows, state):
        def told():
            nonlocal state
            for row in rows:
                made, state = step(key, row, state)
                yield from made

        yield from _framed(told(), columns)
        return state

    names = [c for c in slim.columns if c != by]

    def stepped(key, rows, state):
        # Columns come in the frame's order; the key is one of them.
        at = slim_columns.index(by)
        return (yield from fold(key, (r[:at] + r[at + 1 :] for r in rows), state))

    slim_columns = [*names, by]
    ordered = slim.select(*slim_columns)
    return ordered.groupBy(by).transformWithStateInPandas(InOrder(state, start, stepped), out, "append", "None")


def pack_stream(docs: DataFrame, order: str, by: str, stride: int) -> DataFrame:
    """(by, window, bytes) of a stream of documents; the remainder of a source waits in its state and is never flushed.

    State is keyed by source, so the windows do not depend on how the stream is partitioned.
    """

    def step(key, row, state):
        data, window = bytes(state[0]) + bytes(row[1]), state[1]
        full = len(data) // stride
        return ((key, window + i, data[i * stride : (i + 1) * stride]) for i in range(full)), (data[full * stride :], window + full)

    slim = framed(docs).select(F.col(order).alias("ord"), "bytes", F.col(by).cast("string").alias(by))
    return _folded(slim, by, f"{by} string, window long, bytes binary", "rest binary, window long", (b"", 0), step)


def smooth_stream(rows: DataFrame, seq: str, pos: str, value: str, p: str, low: float = 1e-4) -> DataFrame:
    """(seq, pos, z): the running mixture of chunk values, its last value kept per sequence."""

    def step(key, row, state):
        place, x, gate = row
        gate = min(1 - low, max(low, gate))
        z = gate * x + (1 - gate) * state[0]
        return ((key, place, z),), (z,)

    slim = rows.select(F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("value"), F.col(p).cast("double").alias("p"), F.col(seq).cast("string").alias(seq))
    return _folded(slim, seq, f"{seq} string, pos long, z double", "z double", (0.0,), step)


def decode_stream(pieces: DataFrame, seq: str, pos: str, data: str) -> DataFrame:
    """(seq, pos, text) of a stream of byte pieces: what each piece completes; an unfinished character waits in the state."""

    def step(key, row, state):
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        decoder.setstate((bytes(state[0]), 0))
        text = decoder.decode(bytes(row[1]))
        return ((key, row[0], text),), (decoder.getstate()[0],)

    slim = pieces.select(F.col(pos).cast("long").alias("pos"), F.col(data).alias("data"), F.col(seq).cast("string").alias(seq))
    return _folded(slim, seq, f"{seq} string, pos long, text string", "pending binary", (b"",), step)


def run_to_end(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over all that is there, into a table of the folder, and reads it back."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
