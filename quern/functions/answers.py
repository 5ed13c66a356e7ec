"""Numeric answers: extraction, exact reading, exact comparison. A number is its text; no column type holds them all."""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: What counts as a number, and the marks that announce an answer, by priority.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?(?:\s*/\s*[-+]?\d[\d,]*(?:\.\d+)?)?"
MARKS = (r"答え\s*[:：]\s*(?:\\boxed\{)?\s*", r"回答\s*[:：]\s*(?:\\boxed\{)?\s*", r"Answer\s*[:：]\s*(?:\\boxed\{)?\s*", r"####\s*", r"\\boxed\{\s*")
#: What has to follow the number, for marks that ask for it.
CLOSED = {r"\\boxed\{\s*": r"\s*\}"}
#: A fraction has the value of its division to this many significant digits, half even.
DIGITS = 28


def _last(c: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1))


def readable(number: Column) -> Column:
    """The number's text without spaces and thousands separators; null if it is none, or divides by zero."""
    tidy = F.regexp_replace(number, r"[\s,]", "")
    one = r"[-+]?\d+(?:\.\d+)?"
    whole = tidy.rlike(f"^{one}$") | (tidy.rlike(f"^{one}/{one}$") & F.split_part(tidy, F.lit("/"), F.lit(2)).rlike("[1-9]"))
    return F.when(whole, tidy)


def extract(text: Column) -> Column:
    """The number text of the answer: the last one after a mark, marks by priority; else the last number.

    Text is expected to be compatibility-normalised already.
    """
    marked = [readable(_last(text, f"(?i){m}({NUMBER}){CLOSED.get(m, '')}", 1)) for m in MARKS]
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), readable), lambda p: p.isNotNull())
    return F.coalesce(*marked, F.try_element_at(found, F.lit(-1)))


def value(number: str, digits: int = DIGITS) -> decimal.Decimal:
    """Of a readable number's text."""
    top, _, bottom = number.partition("/")
    context = decimal.Context(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)
    return context.divide(decimal.Decimal(top), decimal.Decimal(bottom)) if bottom else decimal.Decimal(top)


@F.pandas_udf(BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and (x == y or value(x) == value(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def equal(a: Column, b: Column) -> Column:
    """Whether two readable number texts have the same value, of any length; decimals compare exactly, nulls equal nothing.

    A fraction is its division to DIGITS significant digits: 1/3 equals 2/6, and 0.333... with that many digits.
    """
    return _same(a, b)


def external(text: Column, pattern: str) -> Column:
    """The first group of a configured answer pattern; empty without a match."""
    return F.regexp_extract(text, pattern, 1)
