"""Combining sources: concatenation, weighted interleaving, hold-out splits, de-duplication, set difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.schedules import half_even_count
from quern.operators.ordering import running, uniform
from quern.operators.packing import probabilities


def concatenate(frames: list[DataFrame] | dict[str, DataFrame], order: str) -> DataFrame:
    """All rows with (source_ord, order); missing columns are null. Frames by name come in the order of their names."""
    listed = [frames[k] for k in sorted(frames)] if isinstance(frames, dict) else frames
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source_ord", F.lit(i)) for i, f in enumerate(listed)])


def concatenate_by(df: DataFrame, by: str) -> DataFrame:
    """``concatenate`` of the sources that lie in one frame, told apart by a column: source_ord is the place of the name among all names.

    One pass over the rows, however many sources there are; rows without a source belong to none.
    """
    names = df.where(F.col(by).isNotNull()).select(F.col(by).alias("_name")).distinct()
    ranked = running(names, "_name", F.lit(1), "source_ord").withColumn("source_ord", F.col("source_ord").cast("int"))
    return df.join(ranked, F.col(by) == F.col("_name")).drop("_name", by)


def slots(spark: SparkSession, shares: list[float], n: int, seed: int) -> DataFrame:
    """(slot, source, rank): n draws of a source each, and the how-manieth draw of its source it is."""
    u = uniform("slot", seed=seed)
    edges = [sum(shares[: i + 1]) for i in range(len(shares) - 1)]
    source = sum(((F.col("u") >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    drawn = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", u).withColumn("source", source)
    return running(drawn, "slot", F.lit(1), "rank", ["source"]).select("slot", "source", (F.col("rank") + 1).alias("rank"))


def interleave(frames: list[DataFrame], takes: list[int], order: str, seed: int = 0) -> DataFrame:
    """Rows of the frames in drawn order, with slot and source, until a draw finds its source exhausted.

    Sources with no take are left out; one source passes through; with none the result is empty.
    """
    live = [(f, t) for f, t in zip(frames, takes, strict=True) if t > 0]
    if not live:
        return frames[0].where(F.lit(False)).withColumn("source", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    numbered = reduce(DataFrame.unionByName, [f.withColumn("source", F.lit(i)) for i, (f, _) in enumerate(live)])
    return _drawn(numbered, [t for _, t in live], order, seed)


def interleave_by(df: DataFrame, by: str, takes: dict[str, int], order: str, seed: int = 0) -> DataFrame:
    """interleave() of the sources that lie in one frame, told apart by a column; sources without a take are left out.

    source is the place of the name among those taken.
    """
    live = {k: t for k, t in takes.items() if t > 0}
    if not live:
        return df.where(F.lit(False)).withColumn("source", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(live) for x in (k, i)])
    numbered = df.withColumn("_s", F.try_element_at(place, F.col(by))).where("_s is not null").drop("source").withColumnRenamed("_s", "source")
    return _drawn(numbered, list(live.values()), order, seed)


def _drawn(numbered: DataFrame, takes: list[int], order: str, seed: int) -> DataFrame:
    if len(takes) == 1:
        return running(numbered, order, F.lit(1), "slot")
    ranked = running(numbered, order, F.lit(1), "rank", ["source"]).withColumn("rank", F.col("rank") + 1)
    sizes = numbered.groupBy("source").agg(F.count("*").alias("size"))
    drawn = slots(numbered.sparkSession, probabilities(takes), numbered.count() + 1, seed)
    spent = drawn.join(sizes, "source", "left").where(F.col("rank") > F.coalesce("size", F.lit(0))).agg(F.min("slot").alias("stop"))
    kept = drawn.join(F.broadcast(spent)).where(F.col("stop").isNull() | (F.col("slot") < F.col("stop"))).drop("stop")
    return kept.join(ranked, ["source", "rank"]).drop("rank")


def two_level(pools: list[list[DataFrame]], takes: list[list[int]], order: str, seed: int = 0) -> DataFrame:
    """Interleaves each pool, then the pools by their summed takes; slot orders the result."""
    mixed = [interleave(f, t, order, seed + 1 + i).drop("source").withColumnRenamed("slot", "_inner") for i, (f, t) in enumerate(zip(pools, takes, strict=True))]
    return interleave(mixed, [sum(max(0, x) for x in t) for t in takes], "_inner", seed).drop("_inner")


def split(df: DataFrame, order: str, by: str, ratio: float) -> DataFrame:
    """Adds part: of each source's n rows the last half-even-rounded share is validation; a source of one row is all train."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    held = F.when(n >= 2, half_even_count(n, ratio)).otherwise(0)
    ranked = running(df, order, F.lit(1), "_rn", [by])
    ranked = ranked.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return ranked.withColumn("part", F.when(F.col("_rn") >= n - held, "val").otherwise("train")).drop("_n", "_rn", "_by")


def tail_shards(shards: DataFrame, order: str, ratio: float) -> DataFrame:
    """Adds part: the last share of all shards is validation; a single shard is all train."""
    n = F.col("_n")
    held = F.when(n >= 2, half_even_count(n, ratio)).otherwise(0)
    ranked = running(shards, order, F.lit(1), "_at").join(F.broadcast(shards.agg(F.count("*").alias("_n"))))
    return ranked.withColumn("part", F.when(F.col("_at") >= n - held, "val").otherwise("train")).drop("_at", "_n")


def first_of(df: DataFrame, key: list[str | Column], order: str, valid: Column | None = None) -> DataFrame:
    """One row of each key: the first by order (null orders last) among the valid ones. A null key is a key.

    Rows that tie in the order go by the hash of their columns (maps apart), so a repeated row stays once. Pre-aggregated: a hot key is one row a task.
    """
    rows = df if valid is None else df.where(valid)
    names = [f"_k{i}" for i in range(len(key))]
    keyed = rows.select(*[(k if isinstance(k, Column) else F.col(k)).alias(n) for n, k in zip(names, key, strict=True)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    told = [f"_row.`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    place = F.struct(F.col(f"_row.`{order}`").isNull().alias("none"), F.col(f"_row.`{order}`").alias("order"), F.xxhash64(*told).alias("hash"))
    return keyed.groupBy(*names).agg(F.min_by("_row", place).alias("_row")).select("_row.*")


def remaining(df: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose key is in none of the finished sets."""
    return reduce(lambda a, d: a.join(d.select(key).distinct(), key, "left_anti"), done, df)


def override(defaults: dict[str, int], given: dict[str, int]) -> dict[str, int]:
    """Known keys of ``given`` over the defaults; takes are at least zero."""
    return {k: max(0, int(given.get(k, v))) if k.endswith("_take") else given.get(k, v) for k, v in defaults.items()}


def zip_outputs(items: DataFrame, outputs: DataFrame, order: str, output: str = "output") -> DataFrame:
    """Items with the outputs of the same place; both frames have the order column, of any values."""
    left, right = running(items, order, F.lit(1), "_at"), running(outputs.select(F.col(order).alias("_o"), output), "_o", F.lit(1), "_to")
    return left.join(right, F.col("_at") == F.col("_to")).drop("_at", "_to", "_o")
