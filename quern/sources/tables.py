"""Tables, metric logs and record files with declared schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators.ordering import row_ids

#: The columns of the two metric logs.
TRAINING_METRICS = "step long, learning_rate double, ce_loss double, ratio_loss double, byte_boundary_loss double, total_loss double"
VALIDATION_METRICS = (
    "step long, validation_batches long, validation_ce_loss double, validation_bpb double, avg_bytes_per_chunk double, target_ratio_gap double, "
    "actual_selected_fraction double, mean_boundary_probability double, stage0_mid_utf8_boundary_fraction double, boundary_positions_sample string, "
    "stage0_selected_fraction double, stage1_selected_fraction double, stage0_target_ratio_gap double, stage1_target_ratio_gap double, "
    "compression_l1_l0 double, compression_l2_l1 double, compression_l2_l0 double"
)


@dataclass(frozen=True)
class Source:
    """One entry of a catalogue; a take of -1 is all."""

    name: str
    split: str = "train"
    config_name: str | None = None
    take_examples: int = -1
    skip_examples: int = 0


def known_fields(cls: type, given: dict) -> object:
    """An instance from the keys it knows; others are ignored, so newer files stay readable."""
    return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})


def catalogue(spark: SparkSession, templates: dict[str, list[Source]]) -> DataFrame:
    """(template, ordinal, name, split, config_name, take_examples, skip_examples) of named, ordered source lists."""
    rows = [(t, i, s.name, s.split, s.config_name, s.take_examples, s.skip_examples) for t, l in templates.items() for i, s in enumerate(l)]
    return spark.createDataFrame(rows, "template string, ordinal int, name string, split string, config_name string, take_examples long, skip_examples long")


def read_templates(text: str) -> dict[str, list[Source]]:
    """Named, ordered source lists from JSON text {name: [source, ...]}; unknown fields are ignored, a source needs its name."""
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("source lists must be a JSON object")
    return {k: [known_fields(Source, s) for s in v if isinstance(s, dict)] for k, v in given.items()}


def resolve(explicit: list[Source], template: str | None, templates: dict[str, list[Source]], defaults: list[Source]) -> list[Source]:
    """An explicit list wins over a template, a template over the defaults."""
    if explicit:
        return explicit
    return templates[template] if template else defaults


def alias(sources: DataFrame) -> DataFrame:
    """Adds alias: NN_name__config__split with unusual characters as underscores."""
    safe = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("dataset"))
    parts = [safe(F.col("name")), F.when(F.col("config_name").isNotNull(), safe(F.col("config_name"))), safe(F.col("split"))]
    return sources.withColumn("alias", F.concat(F.lpad(F.col("ordinal").cast("string"), 2, "0"), F.lit("_"), F.concat_ws("__", *parts)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them (a stream's path must be a folder or a pattern)."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def read_metrics(spark: SparkSession, path: str, schema: str = TRAINING_METRICS, strict: bool = True) -> DataFrame:
    """A metric log; strict fails on what is no number, else blanks and missing values are NaN."""
    df = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(schema).csv(path)
    return df if strict else df.select(*[F.coalesce(c, F.lit(float("nan"))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_metrics(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished records of an earlier run; empty if there are none yet."""
    try:
        return spark.read.schema(schema).json(path).select("*")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def records_to_parquet(spark: SparkSession, path: str, to: str, schema: str) -> None:
    spark.read.schema(schema).json(path).write.mode("overwrite").parquet(to)


def manifest_shards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, bin_file, idx_file, token_count, doc_count) of all shards in JSON source manifests; incomplete entries are skipped."""
    schema = "source string, shards array<struct<bin_file:string,idx_file:string,token_count:bigint,doc_count:bigint>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select("source", F.explode("shards").alias("s"))
    return rows.select("source", "s.*").where("bin_file is not null and token_count is not null")


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the records whose key is not there yet, once each, and returns all: safe to repeat after a failure."""
    old = read_done(df.sparkSession, path, df.schema)
    fresh = df.dropDuplicates([key]).join(old.select(key).distinct(), key, "left_anti").select(*df.columns)
    write_records(fresh, path, append=True)
    return read_done(df.sparkSession, path, df.schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str, event_time: str | None = None, delay: str = "1 day"):
    """A writer that appends a stream's records below ``path``, each key once, however often a batch is repeated.

    Keys seen before are in the query's state, so nothing written is read again; with ``event_time`` the state forgets keys after ``delay``. Each batch is a
    folder named by its number, which the batch replaces: one that failed halfway, or ran twice, leaves what it leaves when it runs once.
    """
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else stream.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``append_stream`` has written."""
    return spark.read.schema(schema).parquet(path).drop("batch")


def write_results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Result records, and beside them their one-row summary."""
    write_records(rows, path)
    write_records(summary.coalesce(1), f"{path}.summary")


def prompts(spark: SparkSession, given: list[str | None]) -> DataFrame:
    """(place, prompt): stripped, blank ones left out, numbered as given."""
    kept = [(i, x.strip()) for i, x in enumerate(y for y in given if y and y.strip())]
    return spark.createDataFrame(kept, "place int, prompt string")


def prompts_of(df: DataFrame, order: str, text: str) -> DataFrame:
    """``prompts`` of a table: stripped, blank and null ones left out, numbered in order."""
    kept = df.select(F.col(order).alias("_o"), strip(F.col(text)).alias("prompt")).where("prompt <> ''")
    return row_ids(kept, "_o", "place").select("place", "prompt")


def progress(df: DataFrame, name: str, **counters) -> tuple[DataFrame, object]:
    """df that counts as it runs, and the observation to read the counts from."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen
