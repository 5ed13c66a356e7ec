"""Text of records whose fields differ in type from row to row: JSON records as VARIANT values, rendered by the type of each value.

``text.render_value`` needs one static type per column; here a field may be a string in one row, a list, a dialogue or a mapping in the next.
All of it is column expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import TEXT_KEYS, python_float, stays, strip

#: Levels of lists and mappings that are rendered; what lies deeper comes as JSON text.
DEPTH = 4
_ITEM = "array<struct<told:boolean,role:string,value:variant>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _mapping(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def scalar(v: Column) -> Column:
    """Text of a scalar as Python writes it: true, 3, 0.5, 1e-05; null is empty.

    Numbers written with a point or exponent are doubles; whole numbers keep all digits (one of 19 digits and more with a point and only zeros
    behind it is taken for a whole one).
    """
    kind = F.schema_of_variant(v)
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),(\d+)\)$", 1).try_cast("int")
    whole = F.endswith(kind, F.lit(",0)")) & (digits >= 19)
    number = kind.isin("DOUBLE", "FLOAT") | (digits.isNotNull() & ~whole)
    return F.coalesce(F.when(number, python_float(F.try_variant_get(v, "$", "double"))).otherwise(F.try_variant_get(v, "$", "string")), F.lit(""))


def json_text(v: Column) -> Column:
    """JSON with sorted keys and a space behind each comma and colon; other characters than quotes, backslashes and control ones as they are."""
    bare = F.replace(F.replace(F.to_json(v), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    # Without escapes, at most one string lies between two separators.
    spaced = F.regexp_replace(bare, r'\G([^",:]*+(?:"[^"]*+")?[^",:]*+)([,:])', "$1$2 ")
    return F.replace(F.replace(spaced, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _turns(messages: Column, told: bool) -> Column:
    """The mappings of a list as (role, content)."""
    rows = F.filter(F.transform(messages, _mapping), lambda m: m.isNotNull())
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    return F.transform(rows, lambda m: F.struct(F.lit(told).alias("told"), F.coalesce(F.try_variant_get(of(m, "role"), "$", "string"), F.lit("")).alias("role"), of(m, "content").alias("value")))


def _plain(v: Column, empty: bool) -> Column:
    """Text of a scalar without white space around it; with ``empty``, null for null and for mere white space."""
    said = strip(scalar(v))
    return F.when(stays(F.try_variant_get(v, "$", "string"), True), said) if empty else said


def _stays(said: Column, empty: bool) -> Column:
    return said.isNotNull() if empty else said != ""


def render(v: Column, depth: int = DEPTH, empty: bool = False) -> Column:
    """Text of a VARIANT, without white space around it.

    With ``empty``, empty strings keep their places among items, turns and parts, and null stands for what says nothing.
    A list of mappings as ``role: content`` lines, any other list as the lines of its non-blank items; a mapping by its
    messages if they say anything, else its content, else its text, else as JSON; scalars by ``scalar``.
    """
    if depth == 0:
        return F.when(_list(v).isNotNull() | _mapping(v).isNotNull(), json_text(v)).otherwise(_plain(v, empty))
    none = F.array().cast(_ITEM)
    item = lambda x: F.struct(F.lit(False).alias("told"), F.lit("").alias("role"), x.alias("value"))

    def text(s: Column) -> Column:
        items, mapping = s["items"], s["mapping"]
        has = lambda k: F.coalesce(F.map_contains_key(mapping, k), F.lit(False))
        messages = _list(F.try_element_at(mapping, F.lit("messages")))
        dialogue = (F.size(items) > 0) & F.forall(items, lambda x: _mapping(x).isNotNull())
        parts = F.when(dialogue, _turns(items, False)).when(items.isNotNull(), F.transform(items, item))
        parts = parts.when(has("content"), F.array(item(F.try_element_at(mapping, F.lit("content")))))
        parts = parts.when(has("text"), F.array(item(F.try_element_at(mapping, F.lit("text"))))).otherwise(none)
        listed = F.concat(F.coalesce(_turns(messages, True), none), parts)
        said = F.transform(listed, lambda x: F.struct(x["told"].alias("told"), x["role"].alias("role"), render(x["value"], depth - 1, empty).alias("text")))
        said = F.filter(said, lambda x: _stays(x["text"], empty))

        def joined(rows: Column) -> Column:
            told = F.exists(rows, lambda x: x["told"])
            chosen = F.filter(rows, lambda x: x["told"] == told)
            lines = F.array_join(F.transform(chosen, lambda x: F.when(x["role"] == "", x["text"]).otherwise(F.concat(x["role"], F.lit(": "), x["text"]))), "\n")
            lines = F.when(F.size(rows) > 0, lines) if empty else lines
            plain = mapping.isNotNull() & ~told & ~has("content") & ~has("text")
            return F.when(plain, json_text(s["whole"])).when(items.isNotNull() | mapping.isNotNull(), lines).otherwise(_plain(s["whole"], empty))

        return _let(said, joined)

    return _let(F.struct(v.alias("whole"), _list(v).alias("items"), _mapping(v).alias("mapping")), text)


def record_text(json: Column, depth: int = DEPTH, empty: bool = False) -> Column:
    """Text of a JSON record: its known keys by priority, else all public keys in their order; distinct parts, blank-line joined.

    Null if nothing is said, and for what is no JSON mapping (of repeated keys, too: see ``fault``). ``empty`` is as in ``render``.
    """
    whole = lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")) if empty else F.nullif(F.array_join(parts, "\n\n"), F.lit(""))

    def text(mapping: Column) -> Column:
        parts = lambda keys: F.filter(F.transform(keys, lambda k: render(F.try_element_at(mapping, k), depth, empty)), lambda x: _stays(x, empty))
        joined = lambda keys: _let(F.array_distinct(parts(keys)), whole) if empty else whole(F.array_distinct(parts(keys)))
        public = F.filter(F.json_object_keys(json), lambda k: ~F.startswith(k, F.lit("_")))
        there = F.map_keys(mapping)
        known = F.filter(F.array(*[F.lit(k) for k in TEXT_KEYS]), lambda k: F.array_contains(there, k))
        return F.coalesce(joined(known), joined(public))

    return _let(_mapping(F.try_parse_json(json)), text)


def fault(json: Column) -> Column:
    """Why a line is no record: null for a good one."""
    v = F.try_parse_json(json)
    return F.when(strip(F.coalesce(json, F.lit(""))) == "", "blank").when(v.isNull(), "no JSON, or repeated keys").when(_mapping(v).isNull(), "no mapping")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): the lines of JSON files, as they are; a file is split like any other text."""
    return spark.read.text(path)
