"""Training schedules and estimates as expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def warm_stable_decay(step: Column, total: int, top: float, bottom: float, warm: float = 0.1, decay: float = 0.2, span: float = 100.0) -> Column:
    """Linear rise, plateau, inverse-square-root fall."""
    rise = max(1, int(total * warm))
    flat_end = max(rise, total - max(1, int(total * decay)))
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - flat_end) / float(max(1, total - flat_end))))
    last = 1 / math.sqrt(span)
    share = (1 / F.sqrt(1 + done * (span - 1)) - last) / max(1e-8, 1 - last)
    return F.when(step < rise, F.lit(top) * (step + 1).cast("double") / float(rise)).when(step < flat_end, F.lit(top)).otherwise(F.lit(bottom) + (top - bottom) * share)


def stage_multipliers(ratios: list[float], widths: list[int], base: float = 4.6) -> list[float]:
    """Learning-rate factor of each level of a hierarchy."""
    whole = math.prod(ratios)
    return [math.sqrt(base * (math.prod(ratios[i:]) / whole) * (widths[-1] / widths[i])) for i in range(len(ratios))]


def stage_multiplier(ratios: list[Column], widths: list[Column], stage: int, base: float = 4.6) -> Column:
    """``stage_multipliers`` for hierarchies that are rows of a table."""
    before = reduce(lambda x, y: x * y, ratios[:stage], F.lit(1.0))
    return F.sqrt(F.lit(base) / before * (widths[-1] / widths[stage]))


def batches(samples: Column, size: int) -> Column:
    return F.ceil(samples / size).cast("long")


def steps(samples: Column, size: int, accumulate: int) -> Column:
    return F.ceil(batches(samples, size) / accumulate).cast("long")


def half_even_count(n: Column, ratio: float) -> Column:
    """Rows held out of n: n * ratio rounded half to even, at least one, at most n - 1."""
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(ratio)).cast("long")))


def parameter_count(n: Column) -> Column:
    """1.23B, 4.56M, or the number itself with separators below a million."""
    return F.when(n >= 1e9, F.format_string("%.2fB", n / 1e9)).when(n >= 1e6, F.format_string("%.2fM", n / 1e6)).otherwise(F.format_string("%,d", n.cast("long")))


def layout_parts(layout: Column) -> Column:
    """[(letter, count)] of a layout such as M1T22m4."""
    hit = F.regexp_extract_all(layout, F.lit(r"([mMtT]\d+)"), 1)
    return F.transform(hit, lambda x: F.struct(F.substring(x, 1, 1).alias("letter"), F.expr("int(0)").alias("zero"), F.regexp_extract(x, r"\d+", 0).cast("int").alias("count")).dropFields("zero"))
