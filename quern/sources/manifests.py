"""Manifests of packed corpora and the sample index beside them, written and read through Spark.

Layout below a folder: ``mix_manifest.json``, ``<source>/manifest.json``, and ``indices/seq_len=L/seed=S`` (Parquet).
Each JSON document may be a plain file or a folder that Spark wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordering import keyed_place, permutation, running
from quern.operators.packing import shard_chunks
from quern.sources.shared import fresh_dir, kept

_SHARD = "struct<bin_file:string,idx_file:string,token_count:bigint,doc_count:bigint>"
_MANIFEST = f"source string, total_tokens bigint, shard_count bigint, shards array<{_SHARD}>"
_MIX = "format string, seed bigint, total_sources bigint, total_tokens bigint, datasets array<struct<name:string,manifest:string,take_examples:bigint,weight:double,total_tokens:bigint>>, index struct<seq_len:bigint,seed:bigint,path:string,total_samples:bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_manifests(manifests: DataFrame, mix: DataFrame, folder: str) -> None:
    """manifests(name, manifest): a JSON document per source; mix(manifest): one for all."""
    manifests.select("name", F.col("manifest").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(f"{folder}/sources")
    mix.select(F.col("manifest").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/mix_manifest.json")


def read_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix manifest as one row; fails clearly where there is none."""
    path = f"{folder}/mix_manifest.json"
    if not exists(spark, path):
        raise FileNotFoundError(f"no mix_manifest.json below {folder}")
    return spark.read.option("multiLine", True).schema(_MIX).json(path)


def total_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(total_tokens): zero where the manifest does not say."""
    return read_mix(spark, folder).select(F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


def mix_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(name, manifest, bin_file, token_count, doc_count) of all shards of the mix; incomplete entries are skipped.

    Each data set's entry meets its own manifest by path, and that manifest's shards.
    """
    entries = read_mix(spark, folder).select(F.explode("datasets").alias("d")).select(F.coalesce("d.name", F.lit("dataset")).alias("name"), F.col("d.manifest").alias("manifest")).where("manifest is not null")
    paths = [r.manifest for r in entries.select("manifest").distinct().collect()]  # one per source
    if not paths:
        return spark.createDataFrame([], "name string, manifest string, bin_file string, token_count bigint, doc_count bigint")
    # The path as read, from the folder on; Spark's own part files lie one level below it.
    found = F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]+/[^/]+)(/part-[^/]*)?$", 1)
    rows = spark.read.option("multiLine", True).schema(_MANIFEST).json([f"{folder}/{p}" for p in paths]).select(found.alias("_at"), F.explode("shards").alias("s"))
    tail = F.regexp_extract("manifest", r"([^/]+/[^/]+)$", 1)
    joined = entries.join(rows, tail == F.col("_at")).select("name", "manifest", "s.bin_file", "s.token_count", "s.doc_count")
    return joined.where("bin_file is not null and token_count is not null")


def write_index(index: DataFrame, folder: str, seq_len: int, seed: int) -> None:
    """index(pos, shard key..., chunk) of one window length and seed."""
    index.write.mode("overwrite").parquet(f"{folder}/indices/seq_len={seq_len}/seed={seed}")


def read_index(spark: SparkSession, folder: str, seq_len: int, seed: int, shards: DataFrame, key: list[str], subset: bool = False) -> DataFrame:
    """(pos, key..., chunk): the written index of this length and seed, else one made anew; a subset of shards is always made anew."""
    path = f"{folder}/indices/seq_len={seq_len}/seed={seed}"
    if not subset and exists(spark, path):
        return spark.read.parquet(path)
    return sample_order(shards, seq_len, seed, key)


def _once(shards: DataFrame, key: list[str]) -> DataFrame:
    """The shards, written: a row each. An order uses them several times and must see the same ranges each time, but Spark computes a frame from a
    Python data source (``read_packed``) anew for each use."""
    return kept(shards.select(*key, "token_count"), f"{fresh_dir(shards.sparkSession)}/shards")


def sample_order(shards: DataFrame, seq_len: int, seed: int, key: list[str]) -> DataFrame:
    """shards(key..., token_count) -> (pos, key..., chunk): all windows of seq_len + 1 in a seeded order."""
    rows = shard_chunks(_once(shards, key), seq_len + 1, *key)
    return permutation(rows.withColumn("_key", F.concat_ws("/", *[F.col(k).cast("string") for k in (*key, "chunk")])), "_key", seed).drop("_key")


def keyed_order(shards: DataFrame, seq_len: int, seed: int, key: list[str], start: int = 0) -> DataFrame:
    """shards(key..., token_count) -> (pos, key..., chunk): all windows of seq_len + 1 in an order by a keyed bijection, from position ``start`` on.

    Only the shards are ranked (by their key as text). Each window's position follows from its number alone, so the windows are neither sorted nor
    shuffled, and a resumed run asks for the positions from ``start`` on at once.
    """
    counts = _once(shards, key).where("token_count >= 0").withColumn("_n", F.expr(f"token_count div {seq_len + 1}"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    based = running(counts.withColumn("_name", name), "_name", "_n", "_base")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    windows = based.where("_n > 0").join(F.broadcast(total)).select(*key, "_base", "_total", F.explode(F.expr("sequence(0, _n - 1)")).alias("chunk"))
    placed = windows.select(keyed_place(F.col("_base") + F.col("chunk"), F.col("_total"), seed).alias("pos"), *key, "chunk")
    return placed.where(F.col("pos") >= start) if start > 0 else placed
