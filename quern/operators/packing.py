"""Byte packing: offsets, fixed windows across documents, padded samples, greedy shards, manifests, sample index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tokens import encode, token_count
from quern.operators.ordering import running


def framed(docs: DataFrame, text: str | Callable[[DataFrame], Column] = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """docs that have text, with bytes and n. text is a column's name, or a formatter: any function from a frame to the
    column of its rows' texts, such as ``record_text``."""
    body = F.col(text) if isinstance(text, str) else text(docs)
    used = docs.withColumn("_text", body).where(F.col("_text") != "")
    return used.withColumn("bytes", encode(F.col("_text"), bos, eos)).withColumn("n", token_count(F.col("_text"), bos, eos)).drop("_text")


def offsets(docs: DataFrame, order: str, by: str, n: str = "n") -> DataFrame:
    """Adds start, the bytes before each row within its stream."""
    return running(docs, order, n, "start", [by])


def windows(docs: DataFrame, order: str, by: str, stride: int) -> DataFrame:
    """(by, window, bytes): the stream of each source cut every ``stride`` bytes; the short tail is dropped.

    Each row takes its own offset along, so rows that repeat an order value, or a whole row, are in the stream as often as they
    come (by their bytes where the order ties), and a null source is a source. Each document is then cut by itself, and pieces meet in their window.
    """
    placed = running(framed(docs).select(by, order, "n", "bytes"), order, "n", "start", [by], [F.col("bytes")])
    placed = placed.withColumn("window", F.explode(F.expr(f"sequence(start div {stride}, (start + n - 1) div {stride})")))
    low = F.greatest(F.col("start"), F.col("window") * stride)
    high = F.least(F.col("start") + F.col("n"), (F.col("window") + 1) * stride)
    piece = F.expr(f"substring(bytes, int(greatest(start, window * {stride}) - start + 1), int(least(start + n, (window + 1) * {stride}) - greatest(start, window * {stride})))")
    parts = placed.select(by, "window", low.alias("at"), (high - low).alias("size"), piece.alias("piece"))
    whole = parts.groupBy(by, "window").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("l"))
    joined = F.aggregate("l", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["piece"]))
    return whole.where(F.col("size") == stride).select(by, "window", joined.alias("bytes"))


def padded(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """One sample per document: its first length + 1 bytes, filled up with the end byte; labels of the filling are -100.

    Adds n (bytes used), input, label_bytes and valid (labels that count); texts of under two bytes are dropped.
    """
    rows = framed(docs, text).withColumn("n", F.least(F.col("n"), F.lit(length + 1)))
    rows = rows.where("n >= 2").withColumn("bytes", F.expr(f"rpad(substring(bytes, 1, {length + 1}), {length + 1}, unhex('FF'))"))
    return rows.withColumn("input", F.substring("bytes", 1, length)).withColumn("label_bytes", F.substring("bytes", 2, length)).withColumn("valid", F.col("n") - 1)


def manifest(shards: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Per shard: token_count, doc_count, and the names of its two files."""
    name = F.format_string("data-%05d", F.col("shard"))
    return shards.groupBy(by, "shard").agg(F.sum(n).cast("long").alias("token_count"), F.count("*").alias("doc_count")).withColumn("bin_file", F.concat(name, F.lit(".bin"))).withColumn("idx_file", F.concat(name, F.lit(".idx")))


def source_manifest(shards: DataFrame, seen: DataFrame, by: str) -> DataFrame:
    """One JSON document per source with totals and its shards in order."""
    listed = shards.groupBy(by).agg(F.sum("token_count").alias("total_tokens"), F.count("*").alias("shard_count"), F.array_sort(F.collect_list(F.struct("shard", "bin_file", "idx_file", "token_count", "doc_count"))).alias("shards"))
    rows = seen.join(listed, by, "left")
    return rows.select(by, F.to_json(F.struct(F.lit("packed-source").alias("format"), F.lit("uint8").alias("dtype"), *[F.col(c) for c in rows.columns])).alias("manifest"))


def shard_chunks(shards: DataFrame, stride: int, *key: str) -> DataFrame:
    """(key..., chunk): every complete window of every shard; a shard below one window has none."""
    full = shards.where(F.col("token_count") >= stride)
    return full.select(*key, F.explode(F.expr(f"sequence(0, token_count div {stride} - 1)")).alias("chunk"))


def weights(rows: DataFrame, take: str) -> DataFrame:
    """Adds weight: take (1 if not positive) over the sum of all."""
    w = F.when(F.col(take) > 0, F.col(take)).otherwise(1)
    return rows.withColumn("weight", w / F.sum(w).over(Window.partitionBy()))


def probabilities(takes: list[int]) -> list[float]:
    """Shares of non-negative takes; fails if there is nothing to take."""
    kept = [max(0, t) for t in takes]
    if sum(kept) <= 0:
        raise ValueError("no source has a positive take")
    return [t / sum(kept) for t in kept]


def packed_estimate(total: Column, stride: int, batch: int, accumulate: int) -> Column:
    """Steps of an epoch over packed tokens, with one floor over all shards."""
    return F.ceil(F.floor(total / stride) / (batch * accumulate)).cast("long")


def mix_manifest(sources: DataFrame, by: str, take: str, total: str, seed: int, manifests: Column | None = None) -> DataFrame:
    """One JSON document for a mix: its sources by name with weights, totals and the relative path of their manifest, and grand totals."""
    path = F.concat(F.lit("sources/name="), F.col("name")) if manifests is None else manifests
    rows = weights(sources, take).withColumnRenamed(by, "name").withColumn("manifest", path)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("name", "manifest", F.col(take).alias("take_examples"), "weight", F.col(total).alias("total_tokens")))).alias("datasets"), F.sum(total).alias("total_tokens"), F.count("*").alias("total_sources"))
    return listed.select(F.to_json(F.struct(F.lit("packed-mix").alias("format"), F.lit(seed).alias("seed"), F.lit("uint8").alias("dtype"), "total_sources", "total_tokens", "datasets")).alias("manifest"))


def document_estimate(sources: DataFrame, take: str, batch: int, accumulate: int) -> DataFrame:
    """(examples, steps) of one pass over the sources' takes; null if any source is unbounded, zero without sources."""
    open_end = F.coalesce(F.bool_or(F.coalesce(F.col(take), F.lit(-1)) <= 0), F.lit(False))
    n = F.coalesce(F.sum(take), F.lit(0)).cast("long")
    return sources.agg(F.when(~open_end, n).alias("examples"), F.when(~open_end, F.floor(n / (batch * accumulate))).cast("long").alias("steps"))
