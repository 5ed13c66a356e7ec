"""Byte tokens: one UTF-8 byte each, framed by two bytes that UTF-8 never uses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the byte vocabulary.
BOS, EOS, VOCABULARY = 0xFE, 0xFF, 256


def encode(c: Column, bos: bool = True, eos: bool = True) -> Column:
    parts = [F.unhex(F.lit("FE"))] * bos + [F.encode(c, "UTF-8")] + [F.unhex(F.lit("FF"))] * eos
    return F.concat(*parts)


def token_count(c: Column, bos: bool = True, eos: bool = True) -> Column:
    return (F.octet_length(c) + F.lit(int(bos) + int(eos))).cast("long")


def decode(c: Column, replace: bool = False) -> Column:
    """Text of bytes: malformed input fails, or is replaced."""
    return F.make_valid_utf8(c.cast("string")) if replace else F.decode(c, "UTF-8")


def display(c: Column) -> Column:
    """Text of framed bytes with <BOS> and <EOS> in place of the frame."""
    pairs = F.regexp_replace(F.hex(c), "(..)", "$1 ")
    parts = F.split(F.regexp_replace(F.regexp_replace(pairs, "FE ", ",3C424F533E,"), "FF ", ",3C454F533E,"), ",")
    return F.make_valid_utf8(F.unhex(F.regexp_replace(F.array_join(parts, ""), " ", "")).cast("string"))


def continuation_bytes(c: Column) -> Column:
    """Bytes 0x80..0xBF of a text: its bytes less its characters."""
    return (F.octet_length(c) - F.length(c)).cast("long")


def input_and_label(window: Column, length: int) -> tuple[Column, Column]:
    """The two shifted halves of a window of length + 1 bytes."""
    return F.substring(window, 1, length), F.substring(window, 2, length)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, pos, data) -> the same with rows that follow each other, in the frame and by pos, as one: their bytes lie side by side already."""
    for batch in batches:
        n, (seq, pos, data) = batch.num_rows, batch.columns
        if n < 2 or pos.null_count or data.null_count or not pa.types.is_integer(pos.type):
            yield batch
            continue
        last, now = seq.slice(0, n - 1), seq.slice(1)
        same = pc.coalesce(pc.equal(last, now), pc.and_(pc.is_null(last), pc.is_null(now))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ~(same & (np.diff(pos.to_numpy()) == 1))]))
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + n + 1]
        ends = np.ascontiguousarray(np.append(ends[starts], ends[-1]))
        merged = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), data.buffers()[2]])
        yield pa.RecordBatch.from_arrays([seq.take(pa.array(starts)), pos.take(pa.array(starts)), merged], names=batch.schema.names)


def assembled_text(pieces: DataFrame, seq: str, pos: str, data: str) -> DataFrame:
    """(seq, text) of byte pieces in order: characters cut between pieces are whole again, malformed bytes are replaced.

    Places are distinct within a sequence. Runs of pieces are joined where they lie, so that what is shuffled is near the bytes, not a row a piece.
    """
    slim = pieces.select(seq, pos, data)
    pieces = slim.mapInArrow(_joined, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields))
    listed = pieces.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct(pos, data))).alias("l"))
    whole = F.unhex(F.array_join(F.transform("l", lambda x: F.hex(x[data])), ""))
    return listed.select(seq, decode(whole, replace=True).alias("text"))
