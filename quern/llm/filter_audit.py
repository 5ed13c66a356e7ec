"""Filter interaction audit: what each of five filters removes, alone and in every order.

Failure conditions of a text: A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals (A-Z) > 5 * code points; D: one of
``#$%&*|`` occurs; E: identical to a text with a smaller doc_id. The failures of a row are a mask, one bit a filter.

Texts are routed by their xxhash fingerprint in an RDD. A task collapses the copies that it sees to one record with the full text and the
least doc_id, so that a text in a third of all rows travels once a task; the records of a fingerprint meet in one partition, where a chain
holds each different text in full with its least doc_id so far. Whatever does not have the least one is sent out as failing E. There are
as many partitions as the input has splits, so a partition holds about a split's worth of different texts.
The masks, a slim table, are written once, and get their labels by a join on doc_id; ``combineByKey`` merges them into one vector of counts for each part (source). All 120 orders follow
from that vector: no order reads the documents again.

Defined cases: null text is empty (A fails); null and empty source are one part, the empty string; null doc_id counts as larger than any
other; rows that repeat a doc_id and a text are copies with the same doc_id and do not make each other fail; several labels of a doc_id: lost is what any of
them marks; null labels and rows without label mark nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_defaults

#: The filters, and the bytes that they look for.
FILTERS = "ABCDE"
_CAPITALS, _MARKS, _WITHIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Bytes of texts that a task holds before it sends them on.
HELD = 64 << 20


def mask_of(raw: bytes) -> int:
    """Which of the filters on a text alone it fails."""
    words = raw.split()
    size = lambda without: len(raw) - len(raw.translate(None, without))
    fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * size(_CAPITALS) > 5 * (len(raw) - size(_WITHIN)), size(_MARKS) > 0)
    return sum(1 << i for i, x in enumerate(fails) if x)


class Entry:
    """A text with the least doc_id seen so far and the rows by part that have that doc_id."""

    __slots__ = ("raw", "mask", "least", "parts")

    def __init__(self, raw: bytes | None, mask: int, least: tuple, parts: Counter):
        self.raw, self.mask, self.least, self.parts = raw, mask, least, parts

    def meet(self, least: tuple, parts: Counter) -> tuple[tuple, Counter] | None:
        """Takes in rows of the same text; returns those that do not have the least doc_id."""
        if least == self.least:
            self.parts = self.parts + parts
            return None
        if least > self.least:
            return least, parts
        out = self.least, self.parts
        self.least, self.parts = least, parts
        return out


def _name(doc_id: int | None) -> tuple[bool, int]:
    """Null last."""
    return doc_id is None, doc_id or 0


def _route(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(doc_id, part, text) -> (fingerprint, (text, mask, least, parts)), and without text what has been found to fail E."""
    chains: dict[int, list[Entry]] = {}
    size = 0

    def flush():
        for key, chain in chains.items():
            for e in chain:
                yield key, (e.raw, e.mask, e.least, e.parts)
        chains.clear()

    for doc_id, part, raw in rows:
        raw = bytes(raw)
        key, least, parts = xxhash.xxh64_intdigest(raw), _name(doc_id), Counter((part,))
        chain = chains.setdefault(key, [])
        found = next((e for e in chain if e.raw == raw), None)
        if found is None:
            chain.append(Entry(raw, mask_of(raw), least, parts))
            size += len(raw)
        elif out := found.meet(least, parts):
            # Without its text a record needs no certain place.
            yield xxhash.xxh64_intdigest(repr(out[0])), (None, found.mask, *out)
        if size > HELD:
            yield from flush()
            size = 0
    yield from flush()


def _settle(records: Iterable) -> Iterator[tuple]:
    """Routed records -> (doc_id, part, mask, n_rows)."""
    chains: dict[int, list[Entry]] = {}

    def rows(least: tuple, parts: Counter, mask: int):
        for part, n in parts.items():
            yield (None if least[0] else least[1]), part, mask, n

    for key, (raw, mask, least, parts) in records:
        if raw is None:
            yield from rows(least, parts, mask | COPY)
            continue
        chain = chains.setdefault(key, [])
        found = next((e for e in chain if e.raw == raw), None)
        if found is None:
            chain.append(Entry(raw, mask, least, parts))
        elif out := found.meet(least, parts):
            yield from rows(*out, mask | COPY)
    for chain in chains.values():
        for e in chain:
            yield from rows(e.least, e.parts, e.mask)


def failures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) -> (doc_id, part, mask, n_rows): which filters a document fails, as bits in the order of FILTERS."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).rdd
    parts = max(with_defaults(docs, spark), rows.getNumPartitions())
    settled = rows.mapPartitions(_route).partitionBy(parts, lambda key: key).mapPartitions(_settle)
    return spark.createDataFrame(settled, "doc_id long, part string, mask int, n_rows long", verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """The doc_ids of texts that a smaller doc_id has already."""
    return failures(docs).where(F.col("mask").bitwiseAND(COPY) != 0).select("doc_id")


def _vectors(labelled: DataFrame):
    """RDD of (part, counts by mask: rows, good ones, toxic ones)."""

    def add(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, n, good, toxic = x
        v[mask] += (n, n * good, n * toxic)
        return v

    pairs = labelled.rdd.map(lambda r: (r.part, (r.mask, r.n_rows, r.good, r.toxic)))
    return pairs.combineByKey(lambda x: add(np.zeros((MASKS, 3), np.int64), x), add, lambda a, b: a + b, with_defaults(labelled, labelled.sparkSession))


def orders(part: str, v: np.ndarray) -> Iterator[tuple]:
    """All orders and steps of one part."""
    masks = np.arange(MASKS)
    out, shapley = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails, gone = (masks & bit) > 0, (masks & before) > 0
            removed, good, toxic = v[fails & ~gone].sum(0).tolist()
            kept = int(v[~fails & ~gone, 0].sum())
            out.append((f, "".join(order), step, kept, removed, int(v[fails & gone, 0].sum()), int(v[bit, 0]), good, toxic))
            shapley[f] += removed
            before |= bit
    for f, *row in out:
        yield part, *row, shapley[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, source, text), labels(doc_id, quality, toxic) -> one row per part, filter_order and step."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    found = Scratch(docs.sparkSession).keep(failures(docs), "masks")
    # The RDD part stands outside Spark's query plans, so what came out of it is held against what there is.
    seen, there = found.agg(F.sum("n_rows")).first()[0] or 0, docs.count()
    if seen != there:
        raise RuntimeError(f"{seen} rows were audited, {there} are there: docs must be the same each time it is read")
    labelled = found.join(marks, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n_rows", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = _vectors(labelled).flatMap(lambda x: orders(*x))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return docs.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names), verifySchema=False)


ORACLE = r"""with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') x from documents),
w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by x) least from t),
m as (select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::int
  + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * (least is not null and (doc_id is null or doc_id > least))::int mask from w),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels where doc_id is not null group by 1),
v as (select part, mask, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from m left join l using (doc_id) group by 1, 2),
f as (select f, bit from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(f, bit)),
o as (select a.f || b.f || c.f || d.f || e.f filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] bit, list_sum(bits[1:step - 1])::int before from o, range(1, 6) r(step)),
k as (select part, filter_order, step::int step, bit, sum(n) filter (mask & bit = 0 and mask & coalesce(before, 0) = 0) kept, sum(n) filter (mask & bit > 0 and mask & coalesce(before, 0) = 0) removed,
  sum(n) filter (mask & bit > 0 and mask & coalesce(before, 0) > 0) redundant, sum(n) filter (mask = bit) unique_fails, sum(good) filter (mask & bit > 0 and mask & coalesce(before, 0) = 0) good_lost,
  sum(toxic) filter (mask & bit > 0 and mask & coalesce(before, 0) = 0) toxic_lost from v, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
  coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, sum(coalesce(removed, 0)) over (partition by part, bit)::bigint shapley from k"""
