"""Text rules as column expressions. Python's notion of white space is spelled out where it matters."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

#: What Unicode calls white space, and the control separators.
_EDGE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_GAP = r"(?U)[\s\x1c-\x1f]+"
#: Record keys in the order in which their texts are taken.
TEXT_KEYS = ("text", "content", "completion", "response", "output", "answer", "prompt", "instruction", "question", "input", "context", "title")


def strip(c: Column | str) -> Column:
    """Without white space at both ends, full-width and control separators included; what lies between is not looked at."""
    return F.btrim(c if isinstance(c, Column) else F.col(c), F.lit(_EDGE))


def stays(c: Column, empty: bool = False) -> Column:
    """Whether a text says anything; with ``empty``, an empty text keeps its place too, and only mere white space goes."""
    said = F.ltrim(c, F.lit(_EDGE)) != ""  # unlike strip, stops at the first character that stays
    return said | (c == "") if empty else said


def unblank(c: Column) -> Column:
    """The text, emptied if it is mere white space."""
    return F.when(stays(c), c).when(c.isNotNull(), "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once, however often f uses it: within lambdas Spark shares no common parts."""
    return F.transform(F.array(c), f)[0]


def plain(c: Column) -> Column:
    """Text of a scalar column: null is empty, booleans are true/false."""
    return F.coalesce(c.cast("string"), F.lit(""))


def python_float(c: Column) -> Column:
    """Text of a double as Python writes it: 1e-05 for 1.0E-5, 12345678.0 for 1.2345678E7, nan, inf."""
    s = c.cast("double").cast("string")
    sign, rest = F.when(F.startswith(s, F.lit("-")), "-").otherwise(""), F.regexp_replace(s, "^-", "")
    digits = F.regexp_replace(F.split_part(rest, F.lit("E"), F.lit(1)), r"\.", "")
    digits = F.when(F.length(digits) > 1, F.regexp_replace(digits, "0+$", "")).otherwise(digits)
    digits = F.when(digits == "", "0").otherwise(digits)
    power = F.split_part(rest, F.lit("E"), F.lit(2)).try_cast("int")
    lead, tail = F.substring(digits, 1, 1), F.substring(digits, 2, 400)
    exponent = F.concat(lead, F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0")))
    large = F.concat(F.substring(large, F.lit(1), power + 1), F.lit("."), F.coalesce(F.nullif(F.substring(large, power + 2, F.lit(400)), F.lit("")), F.lit("0")))
    shown = F.when(power.isNull(), rest).when((power < -4) | (power >= 16), exponent).when(power < 0, small).otherwise(large)
    return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, shown))


def _scalar(c: Column, kind: DataType) -> Column:
    return F.coalesce(python_float(c) if isinstance(kind, (DoubleType, FloatType)) else c.cast("string"), F.lit(""))


def _lines(messages: Column, kind: StructType) -> Column:
    """render_messages for elements of any struct type; a missing role or content is empty."""
    part = lambda m, name: render_value(m[name], kind[name].dataType, True) if name in kind.names else F.lit("")
    lines = F.transform(F.filter(messages, lambda m: m.isNotNull()), lambda m: F.struct(part(m, "role").alias("r"), strip(part(m, "content")).alias("c")))
    return F.array_join(F.transform(F.filter(lines, lambda m: m["c"] != ""), lambda m: F.when(m["r"] == "", m["c"]).otherwise(F.concat(m["r"], F.lit(": "), m["c"]))), "\n")


def render_value(c: Column, kind: DataType, nested: bool = False) -> Column:
    """Text of a column of any type, by its type.

    Scalars as they are; a list of structs as message lines, any other list as the lines of its non-blank items; a struct by
    its messages if they say anything, else its content, else its text, else as JSON with sorted keys. Null is empty; other
    types (binary, times) are their string form. JSON within a list (``nested``) keeps its keys' order.
    """
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, StructType):
            return F.coalesce(_lines(c, inner), F.lit(""))
        items = F.filter(F.transform(c, lambda x: strip(render_value(x, inner, True))), lambda x: x != "")
        return F.coalesce(F.array_join(items, "\n"), F.lit(""))
    if isinstance(kind, (StructType, MapType)):
        rest = F.to_json(c, {"ignoreNullFields": "false"})
        rest = F.coalesce(rest if nested else spaced_json(rest), F.lit(""))
        if isinstance(kind, MapType):
            get, has, of = (lambda k: F.try_element_at(c, F.lit(k))), (lambda k: F.map_contains_key(c, k)), (lambda k: kind.valueType)
            text = F.when(has("content"), render_value(get("content"), of("content"), nested)).when(has("text"), render_value(get("text"), of("text"), nested)).otherwise(rest)
            known = isinstance(kind.valueType, ArrayType) and {"messages"}
        else:
            of = lambda k: kind[k].dataType
            key = next((k for k in ("content", "text") if k in kind.names), None)
            text, known = (render_value(c[key], of(key), nested) if key else rest), set(kind.names)
            get = lambda k: c[k]
        if known and "messages" in known and isinstance(of("messages"), ArrayType) and isinstance(of("messages").elementType, StructType):
            joined = F.coalesce(_lines(get("messages"), of("messages").elementType), F.lit(""))
            text = F.when(joined != "", joined).otherwise(text)
        return F.when(c.isNull(), F.lit("")).otherwise(text)
    return _scalar(c, kind)


def record_text(df: DataFrame, exclude: tuple[str, ...] = (), empty: bool = False) -> Column:
    """render_record over all columns of a frame, of any types."""
    return render_record({f.name: render_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name not in exclude}, empty)


def render_messages(messages: Column) -> Column:
    """``role: content`` lines of an array of (role, content); blank contents are left out, so are empty roles."""
    lines = F.transform(messages, lambda m: F.struct(strip(plain(m["role"])).alias("r"), strip(plain(m["content"])).alias("c")))
    lines = F.filter(lines, lambda m: m["c"] != "")
    return F.array_join(F.transform(lines, lambda m: F.when(m["r"] == "", m["c"]).otherwise(F.concat(m["r"], F.lit(": "), m["c"]))), "\n")


def render_record(columns: dict[str, Column], empty: bool = False) -> Column:
    """A record's text: its known keys by priority, else all public keys in order; distinct parts, blank-line joined; else null.

    With ``empty``, empty parts keep their places beside others.
    """

    def joined(parts: list[Column]) -> Column:
        if not parts:
            return F.lit(None).cast("string")
        kept = F.transform(F.filter(F.array(*parts), lambda x: stays(x, empty)), strip)
        return F.nullif(F.array_join(F.array_distinct(kept), "\n\n"), F.lit(""))

    known = [columns[k] for k in TEXT_KEYS if k in columns]
    public = [c for k, c in columns.items() if not k.startswith("_")]
    return F.coalesce(joined(known), joined(public))


def normal_compare(c: Column) -> Column:
    """For comparing short answers: stripped, full-width spaces as spaces, lower case."""
    return F.lower(F.replace(strip(c), F.lit("　"), F.lit(" ")))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _composed(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)


#: nfkc by rows: a worker holds a hundred texts, whatever their length, where a batch for Arrow has up to 10,000.
nfkc_long = F.udf(_composed, StringType(), useArrow=False)


def clean(c: Column) -> Column:
    """Compatibility-normalised, white space collapsed, stripped; null is empty."""
    return F.regexp_replace(strip(nfkc_long(plain(c))), _GAP, " ")


def render_bytes(raw: bytes) -> str:
    """Valid UTF-8 as text, other bytes as <0xHH>."""
    return raw.decode("utf-8", "hexed") if raw else "<empty>"


def _hexed(e: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(f"<0x{b:02X}>" for b in e.object[e.start : e.end]), e.end


def register_hexed() -> None:
    import codecs

    codecs.register_error("hexed", _hexed)


@F.pandas_udf(StringType())
def render_chunk(s: pd.Series) -> pd.Series:
    register_hexed()
    return s.map(lambda x: None if x is None else render_bytes(bytes(x)))


@F.pandas_udf(StringType())
def spaced_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys and spaced separators, as Python writes it; invalid text is empty."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return ""

    return s.map(one)


def json_object(c: Column) -> Column:
    """The widest {...} of a text without code fences; empty if there is none."""
    return F.regexp_extract(strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))), r"(?s)\{.*\}", 0)
