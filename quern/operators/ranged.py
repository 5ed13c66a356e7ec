"""Window functions over long ordered groups, cut into ranges that run at once.

A group (a sequence) with a third of all rows is dealt out over ranges of its order. Within a range the window function runs as usual; what
it would see beyond the range's edge comes from the summaries of the group's other ranges: one row a range, so their own window is short.
All functions of one call share one exchange of the rows: the key of the range serves the sort and the join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.operators.ordering import in_ranges

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Carry:
    """A window function in ranges.

    ``own`` over the rows of a range, in order; ``edge``, an aggregate of a range that others need; ``carried``, over the edges of a group's
    ranges, in order; ``whole``, the result from own and carried.
    """

    own: Callable[[WindowSpec], Column]
    edge: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec], Column]
    whole: Callable[[Column, Column], Column]


def _boxed(value: Column) -> Column:
    """Told apart from no row at all, even if null."""
    return F.struct(value.alias("v"))


def lag(value: Column) -> Carry:
    """The value of the row before; null for the first row."""
    box = _boxed(value)
    return Carry(lambda w: F.lag(box).over(w), lambda place: F.max_by(box, place), lambda e, w: F.lag(e).over(w), lambda own, far: F.coalesce(own, far)["v"])


def lead(value: Column) -> Carry:
    """The value of the row after; null for the last row."""
    box = _boxed(value)
    return Carry(lambda w: F.lead(box).over(w), lambda place: F.min_by(box, place), lambda e, w: F.lead(e).over(w), lambda own, far: F.coalesce(own, far)["v"])


def total(value: Column, inclusive: bool = False) -> Carry:
    """The sum over the rows before, and of the row itself if inclusive; 0 for none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Carry(lambda w: zero(F.sum(value).over(w.rowsBetween(_FIRST, 0 if inclusive else -1))), lambda _: F.sum(value), lambda e, w: zero(F.sum(e).over(w.rowsBetween(_FIRST, -1))), lambda own, far: own + far)


def latest(value: Column) -> Carry:
    """The last value that is not null, at or before the row."""
    return Carry(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(_FIRST, 0)),
        lambda place: F.max_by(value, F.when(value.isNotNull(), place)),
        lambda e, w: F.last(e, ignorenulls=True).over(w.rowsBetween(_FIRST, -1)),
        lambda own, far: F.coalesce(own, far),
    )


def following(value: Column) -> Carry:
    """The first value that is not null, after the row."""
    return Carry(
        lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(1, _LAST)),
        lambda place: F.min_by(value, F.when(value.isNotNull(), place)),
        lambda e, w: F.first(e, ignorenulls=True).over(w.rowsBetween(1, _LAST)),
        lambda own, far: F.coalesce(own, far),
    )


def laid(df: DataFrame, by: list[str], order: Column | list[Column], place: Column | None = None) -> DataFrame:
    """df with _rk, the order, and _rg, the group and range of each row. Calls of ``windowed`` on it share its ranges and its exchange."""
    listed = order if isinstance(order, list) else [order]
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(listed)])
    return in_ranges(df, listed[0], place).drop("_k").withColumn("_rk", key).withColumn("_rg", F.struct(*[F.col(f"`{c}`") for c in by], "_b")).drop("_b")


def windowed(df: DataFrame, by: list[str], order: Column | list[Column], place: Column | None = None, **functions: Carry) -> DataFrame:
    """df with a column for each of the functions, over its groups ``by`` in the order (nulls first).

    With an order of several columns, ``place`` is a number that never falls along it. Where the order ties, any of the rows comes first.
    A frame from ``laid`` keeps its ranges; groups and order are then those that it was laid by.
    """
    ranged = df if "_rg" in df.columns else laid(df, by, order, place)
    far = Window.partitionBy(*[f"_rg.`{c}`" for c in by]).orderBy("_rg._b")
    near = Window.partitionBy("_rg").orderBy("_rk")
    edges = ranged.groupBy("_rg").agg(*[f.edge(F.col("_rk")).alias(f"_e_{n}") for n, f in functions.items()])
    carried = edges.select("_rg", *[f.carried(F.col(f"_e_{n}"), far).alias(f"_c_{n}") for n, f in functions.items()])
    own = ranged.select("*", *[f.own(near).alias(f"_o_{n}") for n, f in functions.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in functions]
    return own.join(carried, "_rg").select(*kept, *[f.whole(F.col(f"_o_{n}"), F.col(f"_c_{n}")).alias(n) for n, f in functions.items()])
