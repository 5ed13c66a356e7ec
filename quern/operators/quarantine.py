"""Bad records apart from good ones, in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import plain, strip
from quern.operators.chat import ROLES


def role_fault(messages: Column, role: str = "role", known: dict[str, str] | None = None) -> Column:
    """Names the first role of a dialogue that no mapper knows; says so if there are no messages; null for a good one."""
    names = list(known or ROLES)
    low = F.transform(messages, lambda m: F.lower(strip(plain(m[role]))))
    odd = F.filter(low, lambda r: ~r.isin(*names))
    return F.when(messages.isNull() | (F.size(messages) == 0), F.lit("no messages")).when(F.size(odd) > 0, F.concat(F.lit("unknown role: "), F.try_element_at(odd, F.lit(1))))


def first_fault(*faults: Column) -> Column:
    """The first reason that is not null."""
    return F.coalesce(*faults)


def separated(rows: DataFrame, fault: Column, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes rows to ``folder`` in one job, good ones and bad ones side by side, and returns both as read back: the good ones with
    their columns, the bad ones with a column ``reason`` more.

    The rows and ``fault`` are evaluated once, so a row is on one side only, whatever it says the next time. Good + bad = all rows.
    """
    kept = rows.withColumn("reason", fault).withColumn("_bad", F.col("reason").isNotNull())
    kept.write.mode("overwrite").partitionBy("_bad").parquet(folder)
    read = rows.sparkSession.read.schema(kept.schema).parquet(folder)
    return read.where("not _bad").select(*rows.columns), read.where("_bad").select(*rows.columns, "reason")
