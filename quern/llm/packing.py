"""Best-fit packing with a plan from non-negative least squares over a length histogram.

Documents become token ids and an end id, longer ones are cut into full pieces (the first may be shorter). Only the
histogram of piece lengths reaches the driver: at most ``length`` rows, however large the corpus. There,
patterns of up to three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram
by non-negative least squares (multiplicative updates) and rounded, and what they leave is packed best-fit
on the histogram. Pieces take their places by rank among the pieces of their length; ranks come from
per-partition counts, so a length that a third of all pieces share is never gathered anywhere.

Defined cases: null or empty text is one piece holding the end id only; repeated rows are packed each; null
doc_ids stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks, space_cuts
from .common import Scratch, arrow, file_bytes

LENGTH, ROUNDS = 2048, 120
#: Below this character, letters and digits are the same in all versions of Unicode that the libraries use.
_STABLE = "ɐ"
_SPECIAL = "<|endoftext|>"


class Ids(dict):
    """Part of a text after a space -> its ids as little-endian 4-byte integers, in a bounded memory."""

    def __init__(self, json_file: bytes, ranks_file: bytes, pattern: str, most: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.slow = Tokenizer.from_str(json_file.decode())
        self.fast = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=read_ranks(ranks_file), special_tokens={})
        self.most = most

    def one(self, text: str) -> bytes:
        """As the tokenizers library encodes it; the faster library only where both are known to agree."""
        if text and max(text) < _STABLE and _SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[part] = self.one(" " + part)
        return out

    def encode(self, text: str) -> bytes:
        parts = None if _SPECIAL in text else space_cuts(text)
        if parts is None:
            return self.one(text)
        return (self.one(parts[0]) if parts[0] else b"") + b"".join(map(self.__getitem__, parts[1:]))


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all full but perhaps the first."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _emit_pieces(files, pattern: str, most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = None, TaskContext.get().partitionId(), [0] * (most + 1)
        for batch in it:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ids or Ids(*files.value, pattern)
                raw = (ids.encode(text) if text else b"") + b"\0\0\0\0"
                for k, (s, n) in enumerate(cut(len(raw) // 4, most)):
                    rows.append((key, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield arrow(_PIECES, *zip(*rows, strict=True))

    return run


def patterns(lengths: np.ndarray, most: int) -> np.ndarray:
    """Patterns of one to three documents that fill a sequence exactly, as rows of indices (len(lengths): none)."""
    none = len(lengths)
    index = np.full(most + 1, -1)
    index[lengths] = np.arange(none)
    full = np.flatnonzero(lengths == most)
    a, b = np.triu_indices(none)
    gap = most - lengths[a] - lengths[b]
    pair, (a, b, c) = gap == 0, (x[gap > 0] for x in (a, b, index[np.maximum(gap, 0)]))
    p, q = np.triu_indices(none)
    triple = c >= b
    return np.concatenate([
        np.stack([full, np.full_like(full, none), np.full_like(full, none)], 1),
        np.stack([p[pair], q[pair], np.full(pair.sum(), none)], 1),
        np.stack([a[triple], b[triple], c[triple]], 1),
    ])


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths come near the histogram, by least squares."""
    target = np.append(histogram.astype(float), 0.0)
    n = len(target)
    per = np.bincount(rows.ravel(), minlength=n).astype(float)
    per[-1] = 1
    # Start: each length shared evenly among its patterns.
    share = np.append(target[:-1] / np.maximum(per[:-1], 1), np.inf)
    x = np.maximum(share[rows].min(axis=1), 1e-9)
    up = target[rows].sum(axis=1)
    for _ in range(rounds):
        now = np.bincount(rows.ravel(), np.repeat(x, 3), n)
        now[-1] = 0
        x *= up / np.maximum(now[rows].sum(axis=1), 1e-12)
    return x


def plan(histogram: dict[int, int], most: int = LENGTH) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern [(length, times)], repeats)] that packs exactly the histogram."""
    lengths = np.array(sorted(histogram), np.int64)
    left = {int(n): int(histogram[int(n)]) for n in lengths}
    out: list[tuple[list[tuple[int, int]], int]] = []
    rows = patterns(lengths, most) if len(lengths) else np.empty((0, 3), int)
    if len(rows):
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        x = fit_counts(rows, np.array([left[int(n)] for n in lengths], float))
        # Rounding carries the fraction on to the next pattern of the same first length.
        whole = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(np.int64)
        for i in np.flatnonzero(whole > 0)[np.argsort(-whole[whole > 0], kind="stable")]:
            need: dict[int, int] = {}
            for j in rows[i]:
                if j < len(lengths):
                    need[int(lengths[j])] = need.get(int(lengths[j]), 0) + 1
            times = min(int(whole[i]), *(left[n] // m for n, m in need.items()))
            if times > 0:
                for n, m in need.items():
                    left[n] -= m * times
                out.append((list(need.items()), times))
    return out + best_fit(left, most)


def best_fit(left: dict[int, int], most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on counts: sequences of equal content are handled as one."""
    open_: dict[int, list] = {}  # room left -> [[pattern, number]]
    rooms: list[int] = []
    done = []

    def put(room: int, pattern: list, number: int) -> None:
        if room == 0:
            done.append((pattern, number))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, number])

    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        c = left[n]
        while c > 0:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                pattern, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, pattern, number = most, [], c
            fill = min(room // n, c)
            used = min(number, c // fill)
            put(room - fill * n, [*pattern, (n, fill)], used)
            if pattern and number > used:
                put(room, pattern, number - used)
            c -= used * fill
    return done + [(p, k) for room in rooms for p, k in open_[room]]


def places(packed: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted: where the pieces of a length go by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in packed:
        offset = 0
        for n, m in pattern:
            rows.append((n, used.get(n, 0), m, sequence, offset))
            used[n] = used.get(n, 0) + m * repeats
            offset += n * m
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _assign(table):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(zlib.decompress(table.value), np.int64).reshape(5, -1).T
        keys = rows[:, 0] * 2**48 + rows[:, 1]
        for batch in it:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * 2**48 + rank, side="right") - 1
            _, first, times, sequence, offset = rows[at].T
            k = rank - first
            yield arrow(_OUT, *(batch.column(i) for i in range(5)), sequence + k // times, offset + (k % times) * length)

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    What is broadcast does not grow without end: the vocabulary, and a table of at most three rows per pattern (under a
    third of a million patterns for 2048). The pieces' ranks, which grow with the partitions, are joined by sorting.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = spark.sparkContext.broadcast((file_bytes(json_path), file_bytes(ranks_path)))
    pieces = scratch.keep(keyed.mapInArrow(_emit_pieces(files, pattern, length), _DDL), "pieces")
    counts = scratch.keep(pieces.groupBy("length", "part").agg(F.count("*").alias("c")), "counts")
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `length` rows
    table = spark.sparkContext.broadcast(zlib.compress(places(plan(histogram, length)).T.tobytes()))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_assign(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
