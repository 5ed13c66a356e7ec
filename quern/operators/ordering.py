"""Order-dependent operators. Every one takes the ordering column as an argument: frames have no order of their own."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a key and a seed, the same on any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.col(k)).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def skip_take(df: DataFrame, order: str, skip: int = 0, take: int = -1, by: str | None = None, none_if_zero: bool = False) -> DataFrame:
    """Rows skip + 1 .. skip + take by order (within ``by``); take below 1 takes all, unless none_if_zero."""
    if none_if_zero and take == 0:
        return df.where(F.lit(False))
    if by is None and skip <= 0:
        return df.orderBy(order).limit(take) if take > 0 else df
    ranked = running(df, order, F.lit(1), "_rn", [by] if by else None).where(F.col("_rn") >= max(0, skip))
    return (ranked.where(F.col("_rn") < max(0, skip) + take) if take > 0 else ranked).drop("_rn")


def hash_shuffle(df: DataFrame, *key: str, seed: int = 0) -> DataFrame:
    """A repeatable order at random: sorted by the hash of seed and key."""
    return df.orderBy(uniform(*key, seed=seed), *key)


def sample(df: DataFrame, k: int, *key: str, seed: int = 0) -> DataFrame:
    """k rows without replacement (a top-k by hash, no full sort)."""
    return hash_shuffle(df, *key, seed=seed).limit(k)


def in_ranges(df: DataFrame, order: Column, place: Column | None = None) -> DataFrame:
    """Adds _k (the order) and _b, its range: ranges of about equal size, as many as the session's shuffles have.

    ``place`` is a number that never falls along the order; without it the order is a number or a string itself. The ranges' ends
    are one row, found when the plan runs; nothing runs while it is built. Nulls are in the first range, as they come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = df.withColumn("_k", order)
    if n < 2:
        return keyed.withColumn("_b", F.lit(0))
    if place is None:
        place = F.col("_k")
        if dict(keyed.dtypes)["_k"] == "string":  # its first bytes as a number, which sorts alike
            place = F.conv(F.rpad(F.hex(F.substring(F.encode("_k", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    cuts = keyed.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 10_000).alias("_cuts"))
    if n <= 32:
        found = F.size(F.filter("_cuts", lambda c: place > c))
    else:  # the ends ascend: by halving

        def halve(s: Column, _: Column) -> Column:
            middle = F.shiftright(s["lo"] + s["hi"], 1)
            above = place > F.element_at("_cuts", middle + 1)
            open_ = s["lo"] < s["hi"]
            return F.struct(F.when(open_ & above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~above, middle).otherwise(s["hi"]).alias("hi"))

        steps = F.array(*[F.lit(i) for i in range(n.bit_length())])
        found = F.when(place.isNotNull() & F.col("_cuts").isNotNull(), F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), halve)["lo"])
    return keyed.join(F.broadcast(cuts)).withColumn("_b", F.coalesce(found, F.lit(0))).drop("_cuts")


def running(df: DataFrame, order: Column | str, value: Column | str, name: str, by: list[str] | None = None, ties: list[Column] | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row, by order (nulls first), within ``by``; rows that agree in the order go by
    ``ties``, and in any order if they agree in those too.

    In two steps, so that neither the whole frame nor a group with a third of its rows is sorted in one task: sums within
    (group, range), plus the sums of the group's earlier ranges. A row moves once: the key of its range serves the sort and the join.
    """
    by = by or []
    keyed = in_ranges(df, order if isinstance(order, Column) else F.col(order)).withColumn("_run_v", value if isinstance(value, Column) else F.col(value))
    # A struct is equal to one with the same nulls.
    keyed = keyed.withColumn("_run_g", F.struct(*by, "_b"))
    unbounded = Window.unboundedPreceding
    sums = keyed.groupBy("_run_g").agg(F.sum("_run_v").alias("_run_n"))
    earlier = Window.partitionBy(*[f"_run_g.{c}" for c in by]).orderBy("_run_g._b").rowsBetween(unbounded, -1)
    before = sums.select("_run_g", F.coalesce(F.sum("_run_n").over(earlier), F.lit(0)).alias("_run_o"))
    own = F.coalesce(F.sum("_run_v").over(Window.partitionBy("_run_g").orderBy("_k", *(ties or [])).rowsBetween(unbounded, -1)), F.lit(0))
    joined = keyed.withColumn("_run_r", own).join(before, "_run_g")
    return joined.select(*df.columns, (F.col("_run_r") + F.col("_run_o")).cast("long").alias(name))


def row_ids(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """0, 1, 2, ... by order."""
    return running(df, order, F.lit(1), name)


def permutation(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds pos, the row's place in a seeded permutation."""
    return running(df, uniform(key, seed=seed), F.lit(1), "pos")


def numpy_permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(pos, sample_id) exactly as numpy's generator shuffles 0..n-1; made on the driver in 16 bytes a sample, so for moderate n."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return spark.createDataFrame(pa.table({"pos": np.arange(n), "sample_id": order}))


_PRIME, _ROUNDS = 2_147_483_647, 6


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below 2 ** 28 for each round, the first not zero."""
    hashed = [hashlib.md5(f"{seed}:{r}".encode()).hexdigest() for r in range(_ROUNDS)]
    return [(1 + int(h[:7], 16), int(h[7:14], 16), int(h[14:21], 16)) for h in hashed]


class Permutation:
    """A keyed bijection on 0..n-1: a Feistel network on a grid of about sqrt(n) by sqrt(n), walked until it is back among the n.

    Each round adds a quadratic residue of one coordinate to the other, so a round is undone by taking it off. Places outside 0..n-1 are fewer than
    the grid has rows, so a walk takes one step but for about one place in sqrt(n). All numbers stay below 2 ** 62.
    """

    def __init__(self, seed: int):
        self.keys = round_keys(seed)

    @staticmethod
    def grid(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, at = np.unique(n, return_inverse=True)
        a = np.array([math.isqrt(max(0, x - 1)) + 1 for x in sizes.tolist()], np.int64)
        return a[at], (-(-sizes // a))[at]

    def _step(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // b, x % b
        for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            k, c, d = self.keys[r]
            t = ((left if r % 2 else right) % _PRIME * k + c) % _PRIME
            shift = (t * t + d) % _PRIME * (-1 if back else 1)
            if r % 2:
                right = (right + shift) % b
            else:
                left = (left + shift) % a
        return left * b + right

    def walk(self, x: np.ndarray, n: np.ndarray, back: bool = False) -> np.ndarray:
        a, b = self.grid(n)
        y = self._step(x, a, b, back)
        while len(out := np.flatnonzero(y >= n)):
            y[out] = self._step(y[out], a[out], b[out], back)
        return y


def _permuted(x: Column, n: Column | int, seed: int, back: bool) -> Column:
    keyed = Permutation(seed)

    @F.pandas_udf("long")
    def place(x: pd.Series, n: pd.Series) -> pd.Series:
        inside = (x.notna() & n.notna() & (x >= 0) & (x < n)).to_numpy(bool)
        out = pd.Series(pd.NA, index=x.index, dtype="Int64")
        out[inside] = keyed.walk(x[inside].to_numpy(np.int64), n[inside].to_numpy(np.int64), back)
        return out

    return place(x.cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def keyed_place(index: Column, n: Column | int, seed: int) -> Column:
    """Where a seeded permutation of 0..n-1 puts an index: no sort, no shuffle, and the same for a row alone. Null outside 0..n-1."""
    return _permuted(index, n, seed, False)


def keyed_index(place: Column, n: Column | int, seed: int) -> Column:
    """The index that ``keyed_place`` puts at a place."""
    return _permuted(place, n, seed, True)


def batch_of(position: Column, size: int) -> Column:
    """Group number of a 0-based position; the last group may be short."""
    return F.floor(position / size).cast("long")


def resume(df: DataFrame, position: str, done: int, size: int = 1) -> DataFrame:
    """Rows from batch ``done`` on, for batches of ``size`` positions: where an interrupted run left off."""
    return df.where(F.col(position) >= max(0, done) * size)


def shares(df: DataFrame, order: str, workers: int, name: str = "worker") -> DataFrame:
    """Adds the worker of each row, dealt out in turn by order: one ranking for all workers."""
    return row_ids(df, order, name).withColumn(name, F.col(name) % workers)


def share(df: DataFrame, order: str, workers: int, index: int) -> DataFrame:
    """Every workers-th row by order, from the index-th on: disjoint shares that cover the frame."""
    if not 0 <= index < workers:
        raise ValueError("index must be below workers")
    return shares(df, order, workers, "_at").where(F.col("_at") == index).drop("_at")


def first_batches(df: DataFrame, order: str, batches: int, size: int) -> DataFrame:
    """The rows of the first batches by order, cached to be used again; none for no batches."""
    return df.orderBy(order).limit(max(0, batches) * size).cache()


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
