"""Importance resampling towards a target distribution, by hashed word n-grams kept in tries.

Features of a text are its words and its pairs of neighbouring words, repeats counted. Each task grows a trie, laid out in arrays: a node for a word, and
below it one for each word that follows. A node holds its path's CRC state, carried on from the node above it, and its count. Word nodes stay from batch to batch
until there are ``NODES`` of them; pair nodes are those of a batch of ``WORDS`` words. Their counts go into totals per bucket (CRC modulo
``BUCKETS``), which are merged over all tasks. A bucket's gain is the scaled log ratio of its share in the target to its share in the corpus. A second pass walks
each text along such tries again, whose nodes now have their gains attached; a text's weight is the floored mean gain of its features. The score adds
Gumbel noise from a hash of the doc_id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

What leaves the tasks is at most BUCKETS totals each, and BUCKETS gains go back: a bound by parameter, whatever the corpus. Ranks come from a sort
in ranges, numbered where they lie and shifted by the sizes of the ranges before; no range needs the whole table.

Defined cases: A-Z is lower-cased, nothing else; null text has no words; no features: weight 0; an empty target has no features, its shares
are even; a null doc_id is hashed as an empty text, and comes last among ties; repeated rows are counted, scored and drawn each; an empty
table gives no rows; further columns are ignored by ``scores`` and kept by ``drawn``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow, with_defaults

BUCKETS, NODES, WORDS, BLOCK = 10_000, 400_000, 500_000, 1 << 20
#: Bytes of words stay, capitals as small letters; all others part words.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_POLYNOMIAL, _LONG = 0xEDB88320, 48


def blocks(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text; those of a long one block by block, so that they are not all held at once."""
    clean, at = (raw or b"").translate(_WORDS), 0
    while at < len(clean):
        end = clean.find(b" ", at + BLOCK)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _carry_tables(longest: int) -> np.ndarray:
    """[length][place][byte]: what a CRC's byte at a place becomes when ``length`` bytes follow; the parts are added by exclusive or."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
    rows = [np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]]
    for _ in range(longest):
        rows.append((rows[-1] >> np.uint32(8)) ^ one[rows[-1] & 255])
    return np.stack(rows)


_CARRY = _carry_tables(_LONG)


class Trie:
    """Word nodes by number: CRC state, that of the word and a blank, and length. A pair node is (word node, word node that follows)."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.state, self.opened, self.length = (np.empty(0, np.uint32) for _ in range(3))

    def nodes(self, words: list[bytes]) -> np.ndarray:
        """The nodes of words, new ones made."""
        index, known = self.index, len(self.index)
        out = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        if len(index) > known:
            new = list(islice(index, known, None))
            state = [crc32(w) for w in new]
            more = (state, [crc32(b" ", c) for c in state], [len(w) for w in new])
            self.state, self.opened, self.length = (np.concatenate([old, np.array(x, np.uint32)]) for old, x in zip((self.state, self.opened, self.length), more, strict=True))
        return out

    def pair_states(self, pairs: np.ndarray) -> np.ndarray:
        """CRC states of pair nodes: the upper word's state, carried on over the lower word."""
        above, below = pairs >> 32, pairs & 0xFFFFFFFF
        state, length = self.opened[above], self.length[below]
        out = self.state[below].copy()
        short = np.minimum(length, _LONG)
        for place in range(4):
            out ^= _CARRY[short, place, (state >> np.uint32(8 * place)) & 255]
        far = np.flatnonzero(length > _LONG)
        if len(far):
            names = list(self.index)
            out[far] = [crc32(names[w], int(c)) for w, c in zip(below[far].tolist(), state[far].tolist(), strict=True)]
        return out


class Walk:
    """Words of some texts along a trie: a node for each, those that only lead on from an earlier batch, and the nodes of pairs."""

    def __init__(self, trie: Trie, words: list[bytes], starts: list[int], led: bool):
        """``starts``: where texts start; ``led``: the first word was counted before."""
        self.nodes = trie.nodes(words)
        self.counted = np.ones(len(words), bool)
        self.counted[:1] = not led
        follows = np.ones(len(words), bool)
        follows[[0, *starts]] = False
        self.at = np.flatnonzero(follows)
        self.pairs = self.nodes[self.at - 1] << 32 | self.nodes[self.at]


def batches(texts: Iterator[tuple[int, bytes | None]]) -> Iterator[tuple[list[bytes], list[int], list[int], bool]]:
    """(key, text) -> (words, starts, keys, led): batches of about WORDS words; keys are of the texts that start there, or for led ones went on.

    A text that a batch's end cuts goes on in the next one, led by its last word.
    """
    words: list[bytes] = []
    starts: list[int] = []
    keys: list[int] = []
    led = False
    for key, raw in texts:
        starts.append(len(words))
        keys.append(key)
        for block in blocks(raw):
            words += block
            if len(words) >= WORDS:
                yield words, starts, keys, led
                words, starts, keys, led = words[-1:], [0], [key], True
    if keys:
        yield words, starts, keys, led


_TOTALS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])


def _count_task(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = Trie(), np.zeros(buckets, np.int64)
        add = lambda states, n: np.bincount(states % np.uint32(buckets), n, buckets).astype(np.int64)
        texts = ((0, raw.as_py()) for batch in it for raw in batch.column(0))
        for words, starts, _, led in batches(texts):
            if not words:
                continue
            walk = Walk(trie, words, [x for x in starts if x < len(words)], led)
            sums += add(trie.state, np.bincount(walk.nodes[walk.counted], minlength=len(trie.state)))
            pairs, n = np.unique(walk.pairs, return_counts=True)
            sums += add(trie.pair_states(pairs), n)
            if len(trie.index) > NODES:
                trie = Trie()
        at = np.flatnonzero(sums)
        if len(at):
            yield arrow(_TOTALS, at, sums[at])

    return run


def _weigh(trie: Trie, gain: np.ndarray, words: list[bytes], starts: list[int], led: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words and sums of gains of each of the batch's texts."""
    cuts = np.array([*starts, len(words)])
    if not words:
        return np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    walk = Walk(trie, words, [x for x in starts if x < len(words)], led)
    each = np.where(walk.counted, gain[trie.state % np.uint32(len(gain))][walk.nodes], 0)
    pairs, place = np.unique(walk.pairs, return_inverse=True)
    each[walk.at] += gain[trie.pair_states(pairs) % np.uint32(len(gain))][place]
    run = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])
    return run(walk.counted.astype(np.int64)), run(each)


def _body(df: DataFrame, text: str):
    return df.select(F.col(text).cast("binary").alias("text"))


def bucket_totals(corpus: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """How many features fall in each bucket, in the corpus and in the target."""
    sides = [_body(df, text).mapInArrow(_count_task(buckets), "bucket long, n long").withColumn("side", F.lit(i)) for i, df in enumerate((corpus, target))]
    merged = sides[0].unionByName(sides[1]).groupBy("side", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((2, buckets), np.int64)
    for r in merged.collect():  # at most a row for each side and bucket
        out[r.side, r.bucket] = r.n
    return out[0], out[1]


def gains(s: np.ndarray, t: np.ndarray) -> list[int]:
    """Scaled log ratios of the smoothed shares, floored."""
    n, all_s, all_t = len(s), float(s.sum() + len(s)), float(t.sum() + len(t))
    return [math.floor(1000 * math.log(float(t[i] + 1) * all_s / (float(s[i] + 1) * all_t))) for i in range(n)]


def noise(doc_id: int | None, seed: int) -> int:
    """A scaled Gumbel variate from the hash of seed and doc_id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def _score_task(gain: list[int], seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gained, held = Trie(), np.array(gain, np.int64), {}  # row -> doc_id, th, words, sum

        def texts():
            row = 0
            for batch in it:
                for doc_id, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    held[row] = [doc_id, th, 0, 0]
                    yield row, raw.as_py()
                    row += 1

        def done(rows: list[int]) -> pa.RecordBatch:
            out = []
            for doc_id, th, n, total in map(held.pop, rows):
                features = n + max(0, n - 1)
                weight = total // features if features else 0
                out.append((doc_id, th, n, features, weight, weight + noise(doc_id, seed)))
            return arrow(_SCORES, *zip(*out, strict=True))

        for words, starts, keys, led in batches(texts()):
            for key, n, total in zip(keys, *(x.tolist() for x in _weigh(trie, gained, words, starts, led)), strict=True):
                held[key][2] += n
                held[key][3] += total
            if len(trie.index) > NODES:
                trie = Trie()
            if len(keys) > 1:  # the last one may go on
                yield done(keys[:-1])
        if held:
            yield done(list(held))

    return run


_PLACED = pa.schema([*_SCORES, ("part", pa.int32()), ("at", pa.int64())])


def _number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in it:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], schema=_PLACED)
        at += n


def _ranked(docs: DataFrame, target: DataFrame, percent: int, seed: int, least: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    gain = gains(*bucket_totals(docs, target))
    body = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.cast("binary").alias("text"))
    ddl = "doc_id long, th long, n_words long, n_features long, weight long, score long"
    scored = scratch.keep(rows.mapInArrow(_score_task(gain, seed), ddl), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.col("th")]
    able = scored.where(F.col("n_words") >= least)
    laid = able.repartitionByRange(with_defaults(docs, spark), *order).sortWithinPartitions(*order)
    placed = scratch.keep(laid.mapInArrow(_number, f"{ddl}, part int, at long"), "placed")
    # A row for each range of the sort.
    sizes = placed.groupBy("part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.expr(f"{int(percent)} * sum(c) over () div 100").alias("most"))
    place = F.col("before") + F.col("at") + 1
    ranked = placed.join(F.broadcast(sizes), "part").withColumn("rank", F.when(place <= F.col("most"), place))
    names = ["doc_id", "th", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")).select(*names))


def scores(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least: int = 20) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank; rank is null unless the row is drawn.

    Drawn is ``percent`` of the rows of ``least`` words or more.
    """
    return _ranked(docs, target, percent, seed, least).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least: int = 20) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. Of rows that agree in doc_id and text, all come if one is drawn."""
    chosen = _ranked(docs.select("doc_id", "text"), target, percent, seed, least).where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    here = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (here == F.col("_th")), "left_semi")


def oracle(percent: int = 25, seed: int = 7, least: int = 20, buckets: int = BUCKETS) -> str:
    """The same in SQL; the CRC goes byte by byte along its table, which comes from the polynomial."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word_list = rf"regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    steps = ", ".join(f"g{i + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end c from g{i})" for i in range(8))
    return f"""with recursive g0 as (select i, i c from range(256) r(i)), {steps},
x as (select 0 side, doc_id, {word_list} w, rowid_ from (select *, row_number() over () rowid_ from documents) union all select 1, null, {word_list}, null from benchmark),
f as (select side, rowid_, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) feature from x),
u as (select feature, count(*) filter (side = 0) s, count(*) filter (side = 1) t, hex(encode(feature)) h from f group by 1),
n as (select *, row_number() over () id from u),
c(id, h, i, crc) as (select id, h, 0, 4294967295::bigint from n union all
  select id, h, c.i + 1, xor(crc >> 8, g8.c) from c join g8 on g8.i = xor(crc, ('0x' || substr(h, 2 * c.i + 1, 2))::bigint) & 255 where 2 * c.i < length(h)),
b as (select n.feature, n.s, n.t, xor(crc, 4294967295) % {buckets} bucket from c join n using (id) where 2 * c.i = length(c.h)),
k as (select bucket, sum(s) s, sum(t) t from b group by 1),
a as (select sum(s) s, sum(t) t from k),
l as (select bucket, floor(1000 * ln((k.t + 1)::double * (a.s + {buckets})::double / ((k.s + 1)::double * (a.t + {buckets})::double)))::bigint gain from k, a),
v as (select rowid_, count(*) n_features, floor(sum(gain)::double / count(*))::bigint weight from f join b using (feature) join l using (bucket) where side = 0 group by 1),
o as (select x.doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, ('0x' || substr(sha256('{seed}:' || coalesce(x.doc_id::varchar, '')), 1, 8))::bigint h from x left join v using (rowid_) where side = 0),
p as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint score from o),
r as (select *, row_number() over (order by n_words < {least}, score desc, doc_id nulls last) as place, count(*) filter (n_words >= {least}) over () as able from p)
select doc_id, n_features, weight, score, case when n_words >= {least} and place <= {percent} * able // 100 then place end rank from r"""
