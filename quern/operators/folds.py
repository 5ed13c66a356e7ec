"""Sequential folds over long ordered groups, cut into ranges that run at once."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordering import in_ranges
from quern.sources.shared import fresh_dir, kept


def pieces(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """The rows of each (group, range), whole; sorted input."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        same = (pdf[by].eq(pdf[by].shift()) | (pdf[by].isna() & pdf[by].shift().isna())) & pdf["_b"].eq(pdf["_b"].shift())
        cuts = np.flatnonzero(~same.to_numpy()).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            part = pdf.iloc[a:b]
            if held and not ((held[0][by].iloc[0] == part[by].iloc[0] or (pd.isna(held[0][by].iloc[0]) and pd.isna(part[by].iloc[0]))) and held[0]["_b"].iloc[0] == part["_b"].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def ranged_fold(df: DataFrame, by: str, order: str, value: str | list[str], out: str, start, summarise: Callable, chain: Callable, apply: Callable) -> DataFrame:
    """df with a column ``out`` ("name type") made by a fold over each group in order, from the state ``start``.

    ``summarise(values)`` tells of one range what ``chain(state, summary)`` needs to carry a state over it; ``apply(values, state)``
    gives the range's results. Only summaries are chained one after the other, so a group with a third of all rows is
    dealt out like any other. A range must fit a task.
    """
    names = [value] if isinstance(value, str) else value
    pick = (lambda pdf: pdf[value]) if isinstance(value, str) else (lambda pdf: pdf[names])
    df = kept(df, f"{fresh_dir(df.sparkSession)}/rows")  # read for the cuts, the summaries and the results
    keyed = in_ranges(df, F.col(order)).drop("_k")
    laid = keyed.repartition(by, "_b").sortWithinPartitions(by, "_b", order)
    kind = df.schema[by].dataType.simpleString()

    def shorten(batches):
        for piece in pieces(batches, by):
            yield pd.DataFrame({by: piece[by].iloc[:1], "_b": piece["_b"].iloc[:1], "_s": [pickle.dumps(summarise(pick(piece)))]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, states = pdf.sort_values("_b"), start, []
        for s in pdf["_s"]:
            states.append(pickle.dumps(state))
            state = chain(state, pickle.loads(s))
        return pd.DataFrame({by: pdf[by], "_b": pdf["_b"], "_s": states})

    def finish(batches):
        for piece in pieces(batches, by):
            yield piece.drop(columns=["_b", "_s"]).assign(**{out.split()[0]: apply(pick(piece), pickle.loads(piece["_s"].iloc[0]))})

    ddl = f"`{by}` {kind}, _b int, _s binary"
    states = laid.select(by, "_b", *names).mapInPandas(shorten, ddl).groupBy(by).applyInPandas(link, ddl)
    states = states.select(F.col(by).alias("_by"), F.col("_b").alias("_at"), "_s")
    both = keyed.join(states, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_at"))).drop("_by", "_at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out}"
    return both.repartition(by, "_b").sortWithinPartitions(by, "_b", order).select(*df.columns, "_b", "_s").mapInPandas(finish, schema)
