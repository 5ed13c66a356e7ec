"""Embedding near-dedup by a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), in order. Inverted lists are keyed by label, length and
a set of ``SHARED`` pivots, so two vectors meet in a list exactly if they share that many pivots; of
several such lists, the one of their smallest shared pivots decides for the pair. Within a list, cosines in double
precision verify; only link counts and a label per vector leave it, never pairs. Lists above ``CHUNK`` vectors
are dealt out as chunk pairs. Equal vectors collapse to one beforehand, pre-aggregated per task, told by their values.

The number of pivots grows with the square root of the vectors of a length, from PIVOTS up, so the lists' average size does
not grow (it does beyond MOST_PIVOTS); the more pivots, the more of them are listed. Pivots come from a sample (by hash, 8
for each pivot, ``SAMPLE`` at least), each as far as can be from those before it; near-copies
are no pivots, for their order would be chance. Every vector is indexed; pivots are drawn for the ``LENGTHS`` most
frequent vector lengths, and each further length has one list per label, which is verified whole.

Defined cases: null labels, null vectors, zero vectors and vectors with null or non-finite components link with
nothing; neither do vectors of different lengths. Repeated rows are vectors of their own, linked with each
other; of rows that share a vec_id each is returned. An empty table gives an empty result; null vec_ids are their
own component unless linked to another; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, with_defaults
from .components import connected_components

PIVOTS, MOST_PIVOTS, PER_LIST, SAMPLE, APART, LISTED, SHARED, CHUNK, COSINE, LENGTHS = 64, 8_192, 12, 2_000, 0.8, 6, 2, 1_000, 0.98, 64


def usable(vector: str = "embedding"):
    """Not null, without null or non-finite components, and not zero."""
    x = F.col(vector).cast("array<double>")
    big = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~big & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivot_count(n: int) -> int:
    """Pivots for n vectors."""
    return min(MOST_PIVOTS, max(PIVOTS, math.ceil(math.sqrt(n / PER_LIST))))


def listed(pivots: int) -> int:
    """Nearest pivots that describe a vector: one more for each four times as many pivots."""
    return min(pivots, LISTED + max(0, round(math.log(max(1, pivots) / PIVOTS, 4))))


def spread(u: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the rows, farthest first; no two with a cosine above APART."""
    chosen, near = [0], u @ u[0]
    while len(chosen) < most and near.min() <= APART:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, u @ u[chosen[-1]])
    return u[chosen]


_KEYED = pa.schema([("d", pa.int32()), ("list", pa.int64()), ("id", pa.int64()), ("low", pa.list_(pa.int32()))])


def _emit_lists(shared):
    """id, embedding -> a row per set of SHARED listed pivots, with the listed pivots up to the set's largest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                u = unit(np.array([vectors[int(i)].as_py() for i in pick], np.float64))
                p = shared.value.get(int(d), np.zeros((1, d)))  # without pivots of its own: one list
                m = listed(len(p))
                near = np.sort(np.argsort(-(u @ p.T), axis=1, kind="stable")[:, :m], axis=1)
                for c in combinations(range(m), min(SHARED, m)):
                    name = np.zeros(len(pick), np.int64)
                    for i in c:
                        name = name * (MOST_PIVOTS + 1) + near[:, i] + 1
                    width = c[-1] + 1
                    low = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1) * width, pa.int32()), pa.array(near[:, :width].ravel(), pa.int32()))
                    yield arrow(_KEYED, np.full(len(pick), d), name, ids[pick], low)

    return run


_PARTS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _local(adj: np.ndarray) -> np.ndarray:
    """Smallest index linked to each, over a square boolean matrix."""
    label = np.arange(len(adj))
    while True:
        near = np.where(adj, label[None, :], len(adj)).min(axis=1, initial=len(adj))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(cosine: float):
    """Sorted by list: label, d, list, i, j, side, id, weight, low, vector -> per vector: links and a linked one."""

    def solve(rows: list[tuple], name: int) -> tuple:
        side, ids, weight = (np.array([r[k] for r in rows]) for k in range(3))
        u = unit(np.array([r[4] for r in rows], np.float64))
        low = np.concatenate([r[3] for r in rows])
        pivots, at = np.unique(low, return_inverse=True)
        has = np.zeros((len(rows), len(pivots)), np.float32)
        has[np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows]), at] = 1
        # The set of this list is their smallest shared one if they share nothing else up to its largest pivot.
        own = 1 if name <= MOST_PIVOTS else SHARED
        adj = (has @ has.T == own) & (u @ u.T >= cosine)
        np.fill_diagonal(adj, False)
        if side.any():
            adj &= side[:, None] != side[None, :]
        links = adj @ weight
        to = ids[_local(adj)]
        keep = links > 0
        return ids[keep], links[keep], to[keep]

    def run(it):
        now, rows, out = None, [], []
        for batch in it:
            for *key, side, ident, weight, low, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if len(rows) > 1:
                        out.append(solve(rows, now[2]))
                    now, rows = key, []
                rows.append((side, ident, weight, low, vector))
            if out:
                yield arrow(_PARTS, *(np.concatenate(c) for c in zip(*out, strict=True)))
                out = []
        if len(rows) > 1:
            yield arrow(_PARTS, *solve(rows, now[2]))

    return run


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row per row."""
    spark = vectors.sparkSession
    scratch, parts = Scratch(spark), with_defaults(vectors, spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("ok", usable() & F.col("label").isNotNull())
    # A class is one vector's values under one label; its id is a number once it is written.
    classes = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    pivots = {}
    for r in classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect():
        most = pivot_count(r["count"])
        own = classes.where(F.size("embedding") == r.d).orderBy(F.xxhash64("label", "embedding")).limit(max(SAMPLE, 8 * most)).select("embedding").collect()
        pivots[r.d] = spread(unit(np.array([x.embedding for x in own])), most)
    shared = spark.sparkContext.broadcast(pivots)
    lists = classes.select("id", "embedding").mapInArrow(_emit_lists(shared), "d int, list long, id long, low array<int>")
    lists = scratch.keep(lists.join(classes.select("id", "label"), "id"), "lists")
    key = ["label", "d", "list"]
    sizes = lists.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1")
    many = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = lists.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    dealt = dealt.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "low")
    full = dealt.join(classes.select("id", "weight", "embedding"), "id").select(*key, "i", "j", "side", "id", "weight", "low", "embedding")
    full = full.repartition(parts, *key, "i", "j").sortWithinPartitions(*key, "i", "j")
    found = scratch.keep(full.mapInArrow(_verify(cosine), "id long, links long, to long"), "found")
    scratch.drop("lists")
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labelled = classes.select("id", "least", "weight").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lowest = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(lowest, "comp").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    labelled = classes.select("id", F.col("label").alias("_label"), F.col("embedding").alias("_embedding")).join(labelled, "id")
    hashed = lambda *c: F.xxhash64(*c)
    same = (hashed("label", "embedding") == hashed("_label", "_embedding")) & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("ok")
    out = rows.join(labelled, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
