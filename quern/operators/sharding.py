"""Greedy sharding: a new shard starts where a row would overflow one that is not empty.

The fold is sequential, but not its work. Where a shard that opens at a row breaks off follows from running sums alone: at the first row that ends beyond its start plus
the capacity. So each row points to the next one to open a shard, and the shards are the rows on the way from a source's first row. Sources are cut in ranges:

1. Running sums give every row its start; one more pass in order finds the row it points to.
2. Within each range, pointers are followed to the first row outside it: a row of constant size, (row, exit, shards on the way), whatever the capacity.
3. Only rows that some exit leads to can be where the way enters a range. They are walked in one task a source while there are at most ``WALKED`` of them;
   beyond that, exits are doubled by joins, in as many rounds as the number of ranges has bits.
4. Each range numbers its rows from where the way enters it, all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import ranged
from quern.operators.folds import pieces
from quern.sources.shared import fresh_dir, kept

WALKED = 200_000


def _met(rows: DataFrame, other: DataFrame, by: str, key: str, place: str, how: str = "inner") -> DataFrame:
    """rows and the rows of other, of the same source, whose ``place`` is their ``key``; those of other without these two columns."""
    named = other.withColumnRenamed(by, "_by").withColumnRenamed(place, "_met")
    return rows.join(named, F.col(by).eqNullSafe(F.col("_by")) & (F.col(key) == F.col("_met")), how).drop("_by", "_met")


def pointers(placed: DataFrame, by: str, capacity: int) -> DataFrame:
    """placed(by, _b, _at, _start, _n) -> (by, _b, _at, _to): the row, by its place, that opens the next shard; null if none does."""
    row = F.struct("_at", "_start")
    placed = placed.withColumnRenamed("_b", "_in")
    ends = placed.select(by, "_in", "_at", "_start", (F.col("_start") + F.col("_n")).alias("_place"), F.lit(0).alias("_asks"), row.alias("_row"))
    asks = placed.select(by, "_in", "_at", "_start", (F.col("_start") + capacity).alias("_place"), F.lit(1).alias("_asks"), F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"))
    order = [F.col(c) for c in ("_place", "_asks", "_at")]
    found = ranged.windowed(ends.unionByName(asks), [by], order, F.col("_place"), _next=ranged.following(F.col("_row"))).where("_asks = 1")
    # What is first to fill an empty shard stays in it, however large.
    return found.select(by, F.col("_in").alias("_b"), "_at", F.when(F.col("_next._start") > F.col("_start"), F.col("_next._at")).otherwise(F.col("_next._at") + 1).alias("_to"))


def _exits(by: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces(batches, by):
            first, n = int(piece["_at"].iloc[0]), len(piece)
            to = piece["_to"].fillna(-1).astype(np.int64).tolist()
            out, hops = to, [1] * n
            for i in range(n - 1, -1, -1):
                j = to[i] - first
                if 0 <= j < n:
                    out[i], hops[i] = out[j], 1 + hops[j]
            yield pd.DataFrame({by: piece[by], "_b": piece["_b"], "_at": piece["_at"], "_exit": pd.array([None if x < 0 else x for x in out], "Int64"), "_hops": hops})

    return run


def _walked(links: DataFrame, by: str, kind: str) -> DataFrame:
    """The entries on the way from each source's first row, in one task a source."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(a): (b, e, h) for a, b, e, h in zip(pdf["_at"], pdf["_b"], pdf["_exit"], pdf["_hops"], strict=True)}
        out, at, shard = [], 0, 0
        while at is not None and at in rows:
            b, e, h = rows[at]
            out.append((pdf[by].iloc[0], b, at, shard, h))
            at, shard = (None if pd.isna(e) else int(e)), shard + int(h)
        return pd.DataFrame(out, columns=[by, "_b", "_entry", "_shard", "_hops"])

    return links.groupBy(by).applyInPandas(walk, f"`{by}` {kind}, _b int, _entry long, _shard long, _hops long")


def _doubled(links: DataFrame, by: str, rounds: int, folder: str) -> DataFrame:
    """The same by joins: jumps of 1, 2, 4, ... exits, taken from the longest to the shortest."""
    jumps = [links.select(by, "_at", "_exit", "_hops")]
    for k in range(1, rounds):
        further = jumps[-1].select(by, "_at", F.col("_exit").alias("_end"), F.col("_hops").alias("_more"))
        far = _met(jumps[-1], further, by, "_exit", "_at", "left").select(by, "_at", F.col("_end").alias("_exit"), (F.col("_hops") + F.coalesce("_more", F.lit(0))).alias("_hops"))
        jumps.append(kept(far, f"{folder}/jump-{k}"))
    reached = links.where("_at = 0").select(by, F.col("_at").alias("_entry"), F.lit(0).cast("long").alias("_shard"))
    for k, jump in reversed(list(enumerate(jumps))):
        further = _met(reached, jump, by, "_entry", "_at").where("_exit is not null").select(by, F.col("_exit").alias("_entry"), (F.col("_shard") + F.col("_hops")).alias("_shard"))
        reached = kept(reached.unionByName(further), f"{folder}/reached-{k}")
    return _met(reached, links.select(by, "_at", "_b", "_hops"), by, "_entry", "_at").select(by, "_b", "_entry", "_shard", "_hops")


def _numbers(by: str, order: str, n: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in pieces(batches, by):
            start = piece["_start"].to_numpy()
            ends, rows = start + piece["_n"].to_numpy(), len(piece)
            entry, shard = piece["_entry"].iloc[0], int(piece["_before"].iloc[0])
            out = np.full(rows, shard, np.int64)
            i = rows if pd.isna(entry) else int(entry) - int(piece["_at"].iloc[0])
            while i < rows:
                shard += 1
                j = int(np.searchsorted(ends, start[i] + capacity, side="right"))
                j = j + 1 if j < rows and start[j] == start[i] else j
                out[i:j] = shard
                i = j
            yield pd.DataFrame({by: piece[by], order: piece[order], n: piece[n], "shard": out})

    return run


def greedy_shards(docs: DataFrame, order: str, by: str, capacity: int, n: str = "n") -> DataFrame:
    """(by, order, n, shard). Rows that tie in the order come in any order, the same for all that follows."""
    spark = docs.sparkSession
    folder = fresh_dir(spark)
    slim = ranged.laid(docs.select(by, order, n), [by], F.col(order))
    size = F.col(n).cast("long")
    placed = ranged.windowed(slim, [by], F.col(order), _start=ranged.total(size), _at=ranged.total(F.lit(1))).select(by, order, n, size.alias("_n"), F.col("_start").cast("long"), F.col("_at").cast("long"), F.col("_rg._b").alias("_b"))
    placed = kept(placed, f"{folder}/rows")
    kind = placed.schema[by].dataType.simpleString()
    together = lambda df: df.repartition(by, "_b").sortWithinPartitions(by, "_b", "_at")
    ways = together(pointers(placed, by, capacity)).mapInPandas(_exits(by), f"`{by}` {kind}, _b int, _at long, _exit long, _hops long")
    ways = kept(ways, f"{folder}/ways")
    ends = ways.where("_exit is not null").select(F.col(by), F.col("_exit").alias("_entry")).distinct()
    links = kept(_met(ways, ends, by, "_at", "_entry").unionByName(ways.where("_at = 0")), f"{folder}/links")
    most = links.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    reached = _walked(links, by, kind) if most <= WALKED else _doubled(links, by, ranges.bit_length(), folder)
    # A range's rows before its entry, or all of them without one, are in the shard that was open.
    listed = _met(placed.select(by, "_b").distinct(), reached, by, "_b", "_b", "left").select(F.col(by).alias("_by"), F.col("_b").alias("_range"), "_entry", "_shard", "_hops")
    open_ = F.last(F.col("_shard") + F.col("_hops") - 1, ignorenulls=True).over(Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    listed = listed.select("_by", "_range", "_entry", F.coalesce(open_, F.lit(-1)).alias("_before"))
    both = placed.join(listed, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_range"))).drop("_by", "_range")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(by, order, n).schema.fields)
    return kept(together(both).mapInPandas(_numbers(by, order, n, capacity), f"{schema}, shard long"), f"{folder}/shards")
