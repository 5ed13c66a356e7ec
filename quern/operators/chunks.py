"""Chunk boundaries of sequences: routing, chunks, hierarchy, smoothing, expansion, metrics.

Sequences are long tables (seq, pos, ...); all orders are explicit columns. A sequence of any length is dealt out over ranges of its
positions (``ranged``), so that one with a third of all rows takes as many tasks as its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators import ranged
from quern.operators.folds import ranged_fold
from quern.operators.ordering import row_ids


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _over(rows: DataFrame, seq: str, pos: str, **functions: ranged.Carry) -> DataFrame:
    return ranged.windowed(rows, [seq], F.col(pos), **functions)


def routing(vectors: DataFrame, seq: str, pos: str, vector: str, bias: Column | None = None) -> DataFrame:
    """Adds p: half of one minus the cosine with the predecessor, in 0..1; 1 at the start. bias is taken off after that."""
    rows = _over(vectors, seq, pos, _prev=ranged.lag(F.col(vector)))
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    cos = _dot(F.col(vector), F.col("_prev")) / F.greatest(norm(vector) * norm("_prev"), F.lit(1e-12))
    p = F.when(F.col("_prev").isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - cos) / 2)))
    if bias is not None:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p - bias))
    return rows.withColumn("p", p).drop("_prev")


def boundaries(rows: DataFrame, valid: Column | None = None) -> DataFrame:
    """Adds is_boundary: p above one half, on valid positions."""
    return rows.withColumn("is_boundary", (F.col("p") > 0.5) & (F.lit(True) if valid is None else valid))


def chunks(rows: DataFrame, seq: str, pos: str, length: Column) -> DataFrame:
    """(seq, chunk, start, end) from the boundaries; what precedes the first one belongs to none."""
    starts = rows.where("is_boundary").withColumn("_len", length)
    placed = _over(starts, seq, pos, _chunk=ranged.total(F.lit(1)), _next=ranged.lead(F.col(pos)))
    return placed.select(seq, F.col("_chunk").cast("long").alias("chunk"), F.col(pos).alias("start"), F.coalesce("_next", "_len").alias("end"))


def second_level(lower: DataFrame, upper: DataFrame, seq: str, total: Column) -> DataFrame:
    """Chunks of chunks: upper boundaries are ordinals of lower chunks. lower(seq, chunk, start), upper(seq, pos, is_boundary)."""
    at = upper.where("is_boundary").select(F.col(seq).alias("_seq"), F.col("pos").alias("_at"))
    hit = lower.join(at, F.col(seq).eqNullSafe(F.col("_seq")) & (F.col("chunk") == F.col("_at"))).drop("_seq", "_at").withColumn("_total", total)
    placed = _over(hit, seq, "start", _chunk=ranged.total(F.lit(1)), _next=ranged.lead(F.col("start")))
    return placed.select(seq, F.col("_chunk").cast("long").alias("chunk"), "start", F.coalesce("_next", "_total").alias("end"))


def chunk_ordinal(rows: DataFrame, seq: str, pos: str) -> DataFrame:
    """Adds ordinal: boundaries so far, less one."""
    return _over(rows, seq, pos, ordinal=ranged.total(F.col("is_boundary").cast("int"), inclusive=True)).withColumn("ordinal", (F.col("ordinal") - 1).cast("long"))


def compact(rows: DataFrame, seq: str, pos: str) -> DataFrame:
    """Boundary rows only, with their rank as new position."""
    return _over(rows.where("is_boundary"), seq, pos, inner=ranged.total(F.lit(1))).withColumn("inner", F.col("inner").cast("long"))


def segments(rows: DataFrame, seq: str, pos: str, start: Column) -> DataFrame:
    """Adds segment: how many starts lie before or at a row."""
    return _over(rows, seq, pos, segment=ranged.total(start.cast("int"), inclusive=True)).withColumn("segment", F.col("segment").cast("long"))


def as_of(rows: DataFrame, seq: str, pos: str, value: Column, name: str) -> DataFrame:
    """Adds the value of the latest boundary at or before each row."""
    return _over(rows, seq, pos, **{name: ranged.latest(F.when(F.col("is_boundary"), value))})


def smoothed(rows: DataFrame, seq: str, pos: str, value: str, p: str = "p", low: float = 1e-4) -> DataFrame:
    """(seq, pos, z): z = p x + (1 - p) z of before, from zero, p kept in low..1 - low.

    Over a range of a sequence, z is a linear function of the z before it, so ranges are chained by two numbers each.
    """

    def run(values: pd.DataFrame, z: float) -> tuple[np.ndarray, float]:
        gate = np.clip(values["_p"].to_numpy(), low, 1 - low)
        out, keep = (gate * values["_x"].to_numpy()).tolist(), (1 - gate).tolist()
        for i, k in enumerate(keep):
            z = out[i] = out[i] + k * z
        return np.array(out), float(np.prod(keep))

    slim = rows.select(seq, pos, F.col(value).cast("double").alias("_x"), F.col(p).cast("double").alias("_p"))

    def summarise(values: pd.DataFrame) -> tuple[float, float]:
        out, keep = run(values, 0.0)
        return float(out[-1]), keep

    folded = ranged_fold(slim, seq, pos, ["_x", "_p"], "z double", 0.0, summarise, lambda z, s: s[0] + s[1] * z, lambda values, z: run(values, z)[0])
    return folded.select(seq, pos, "z")


def masked_ratio(mask: Column, valid: Column) -> Column:
    """Share of valid positions that are masked, with a denominator of at least one."""
    return F.count_if(mask & valid) / F.greatest(F.count_if(valid), F.lit(1))


def batch_metrics(rows: DataFrame, batch: str, stage: str) -> DataFrame:
    """Per batch and stage: selected share, mean p, and the share of continuation bytes on which a boundary falls.

    rows: batch, stage, p, is_boundary, valid, continuation.
    """
    v = F.col("valid")
    inner = masked_ratio(F.col("is_boundary"), v & F.col("continuation"))
    mean = F.sum(F.when(v, F.col("p")).otherwise(0.0)) / F.greatest(F.count_if(v), F.lit(1))
    return rows.groupBy(batch, stage).agg(masked_ratio(F.col("is_boundary"), v).alias("selected"), mean.alias("mean_p"), inner.alias("mid_character"))


def stage_metrics(per_batch: DataFrame, stage: str, targets: list[float]) -> DataFrame:
    """Unweighted means over batches per stage, and the gap to the stage's target share (the last target serves later stages)."""
    target = F.element_at(F.array(*[F.lit(float(t)) for t in targets]), (F.least(F.col(stage), F.lit(len(targets) - 1)) + 1).cast("int"))
    rows = per_batch.withColumn("_gap", F.col("selected") - 1 / F.greatest(target, F.lit(1e-8)))
    return rows.groupBy(stage).agg(F.avg("selected").alias("selected"), F.avg("mean_p").alias("mean_p"), F.avg("mid_character").alias("mid_character"), F.avg("_gap").alias("gap"))


def summary(stages: DataFrame, stage: str) -> DataFrame:
    """One row: means over stages, compression by level and in all; NaN for a stage that is absent."""
    of = lambda i, c: F.coalesce(F.max(F.when(F.col(stage) == i, F.col(c))), F.lit(float("nan")))
    one = stages.agg(F.avg("selected").alias("actual_selected_fraction"), F.avg("mean_p").alias("mean_boundary_probability"), F.avg("gap").alias("target_ratio_gap"), of(0, "mid_character").alias("mid_character"), of(0, "selected").alias("f0"), of(1, "selected").alias("f1"))
    inverse = lambda x: F.when(F.isnan(x), F.lit(float("nan"))).otherwise(1 / F.greatest(x, F.lit(1e-8)))
    return one.withColumn("compression_l1_l0", inverse(F.col("f0"))).withColumn("compression_l2_l1", inverse(F.col("f1"))).withColumn("compression_l2_l0", inverse(F.col("f0") * F.col("f1")))


def loss_summary(rows: DataFrame, ce: str, n: str) -> DataFrame:
    """Token-weighted mean loss, and in bits."""
    mean = F.sum(F.col(ce) * F.col(n)) / F.sum(n)
    return rows.agg(mean.alias("ce"), (mean / F.log(F.lit(2.0))).alias("bpb"))


def balance_loss(selected: Column, mean_p: Column, ratio: Column) -> Column:
    """Load balance of a router that aims at one boundary in ``ratio`` positions."""
    return ((1 - selected) * (1 - mean_p) + selected * mean_p * (ratio - 1)) * ratio / (ratio - 1)


def continuation_penalty(p: Column, weight: Column) -> Column:
    """Mean of p over positions weighted as continuation bytes."""
    return F.sum(p * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def positions_sample(rows: DataFrame, seq: str, pos: str, most: int = 64) -> DataFrame:
    """(seq, positions): the first boundary positions joined by |, with |... if there are more."""
    first = _over(rows.where("is_boundary"), seq, pos, _rn=ranged.total(F.lit(1))).where(F.col("_rn") <= most)
    listed = first.groupBy(seq).agg(F.array_sort(F.collect_list(pos)).alias("l"))
    text = F.array_join(F.slice("l", 1, most).cast("array<string>"), "|")
    return listed.select(seq, F.concat(text, F.when(F.size("l") > most, F.lit("|...")).otherwise("")).alias("positions"))


def length_quantiles(rows: DataFrame, by: str, length: str, shares: dict[str, float]) -> DataFrame:
    """Per group, the least length that a share of its rows does not pass, for each named share; exact, nulls left out.

    Lengths repeat, so a histogram says all: rows are counted by (group, length) first, and its running sum is dealt out in ranges. No group is held in one task.
    """
    counted = rows.where(F.col(length).isNotNull()).groupBy(by, length).agg(F.count("*").alias("_c"))
    placed = ranged.windowed(counted, [by], F.col(length), _upto=ranged.total(F.col("_c"), inclusive=True))
    totals = counted.groupBy(F.col(by).alias("_by")).agg(F.sum("_c").alias("_n"))
    reached = lambda q: F.col("_upto") >= F.greatest(F.lit(1), F.col("_n") - F.floor(F.col("_n") - q * F.col("_n")))
    both = placed.join(totals, F.col(by).eqNullSafe(F.col("_by")))
    return both.groupBy(by).agg(*[F.min(F.when(reached(q), F.col(length))).alias(name) for name, q in shares.items()])


def sketched(rows: DataFrame, by: list[str], value: str, k: int = 400) -> DataFrame:
    """(by..., sketch): a KLL sketch of whole numbers for each group, some kilobytes however many rows; nulls left out.

    ``merged_sketches`` puts those of finer groups together. A quantile's rank is off by at most ``sketch_error(k)`` of the rows, with 99 % confidence.
    """
    return rows.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_error(k: int) -> float:
    """The largest error in rank of a KLL sketch of size k: its published bound for several quantiles at once."""
    return 2.446 / k**0.9433


def sketch_quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(share))


#: Character classes as sets of a regular expression. They do not overlap.
CHARACTERS = {
    "space": r"\s",
    "letter": "A-Za-z",
    "sign": r"!-/0-9:-@\[-`{-~",
    "japanese": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}",
    "emoji": r"\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}",
}


def character_shares(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Per group: bytes_per_character, and of all characters the share of each class (ASCII letters; ASCII digits and signs) and of the ``other`` ones.

    Counted within each row; groups without characters have null shares.
    """
    n = F.length(text).cast("long")
    kinds = {k: F.sum(n - F.length(F.regexp_replace(text, f"[{c}]", ""))) for k, c in CHARACTERS.items()}
    counted = rows.groupBy(by).agg(F.sum(n).alias("_n"), F.sum(F.octet_length(text).cast("long")).alias("_b"), *[c.alias(k) for k, c in kinds.items()])
    share = lambda c: F.when(F.col("_n") > 0, c / F.col("_n"))
    rest = F.col("_n") - sum((F.col(k) for k in CHARACTERS), F.lit(0))
    return counted.select(by, share(F.col("_b")).alias("bytes_per_character"), *[share(F.col(k)).alias(k) for k in CHARACTERS], share(rest).alias("other"))


def nucleus(rows: DataFrame, group: str, p: str, tie: str, top: float) -> DataFrame:
    """The likeliest rows of each group until their share passes ``top``; at least one."""
    falling = -F.col(p)
    return ranged.windowed(rows, [group], [falling, F.col(tie)], falling, _before=ranged.total(F.col(p))).where(F.col("_before") <= top).drop("_before")


def chunk_report(rows: DataFrame, seq: str, chunk: str, shown: Column) -> DataFrame:
    """(seq, line): the rendered chunks of a sequence in order, each in brackets, comma-separated."""
    listed = rows.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct(chunk, shown.alias("shown")))).alias("l"))
    return listed.select(seq, F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["shown"], F.lit("]"))), ", ").alias("line"))


def cut_bytes(chunked: DataFrame, data: str) -> DataFrame:
    """Adds chunk_bytes, the bytes of each chunk [start, end) of a row's byte column."""
    return chunked.withColumn("chunk_bytes", F.expr(f"substring({data}, int(start + 1), int(end - start))"))


def ratio_loss(stages: DataFrame, stage: str, selected: str, mean_p: str, ratios: list[float]) -> DataFrame:
    """(loss): mean balance loss over stages; the last of the target ratios serves all later stages. Zero without stages."""
    ratio = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), (F.least(F.col(stage), F.lit(len(ratios) - 1)) + 1).cast("int"))
    return stages.agg(F.coalesce(F.avg(balance_loss(F.col(selected), F.col(mean_p), ratio)), F.lit(0.0)).alias("loss"))


def step_losses(rows: DataFrame, step: str, ratio_weight: float, byte_weight: float) -> DataFrame:
    """Per step, the means over its micro-batches of ce_loss, ratio_loss and byte_boundary_loss, and their weighted total."""
    means = rows.groupBy(step).agg(*[F.avg(c).alias(c) for c in ("ce_loss", "ratio_loss", "byte_boundary_loss")])
    return means.withColumn("total_loss", F.col("ce_loss") + ratio_weight * F.col("ratio_loss") + byte_weight * F.col("byte_boundary_loss"))


def predicted(rows: DataFrame, predictor: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """rows with p from an injected model, a function of a batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=pd.Series(predictor(pdf), dtype="float64"))

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", p double")


def report_lines(prompts: DataFrame, order: str, prompt: str, stages: list[str]) -> DataFrame:
    """(order, line): the text block of each prompt in a numbered report; stages are columns of rendered chunk lists.

    Blank prompts are left out before numbering; a blank line follows each block but the last.
    """
    kept = row_ids(prompts.where(strip(F.col(prompt)) != ""), order, "_i")
    n = kept.agg(F.count("*").alias("_n"))
    parts = [F.format_string("[%d/%d]", F.col("_i") + 1, F.col("_n")), F.concat(F.lit("Input prompt: "), prompt), *[F.concat(F.lit(f"{s}: "), s) for s in stages]]
    block = F.concat(F.concat_ws("\n", *parts), F.when(F.col("_i") + 1 < F.col("_n"), F.lit("\n")).otherwise(F.lit("")))
    return kept.join(F.broadcast(n)).select(order, block.alias("line"))


def write_report(lines: DataFrame, order: str, folder: str, step: int) -> str:
    """The report of one step as text; returns its path. Reports are small, one file each."""
    path = f"{folder}/validation_chunks/chunks_step_{step:06d}.txt"
    lines.orderBy(order).select("line").coalesce(1).write.mode("overwrite").text(path)
    return path
