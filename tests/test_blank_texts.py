"""Queries on documents some of whose texts are blank or empty, against their SQL, which keeps the place of such a text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import records, text
from quern.operators import chat
from quern.plans import catalogue
from tests.test_catalogue import norm

TEXTS = ["", " ", "  ", "\n\t ", " a ", "b\n", "src0", "", "\n ", "c\n\nd"]


@pytest.fixture(scope="module")
def docs(tmp_path_factory):
    """Each text under ids of every remainder by five."""
    d = tmp_path_factory.mktemp("blank")
    rows = [(i, TEXTS[(i + i // 10) % 10], ["en", "ja"][i % 2], f"src{i % 3}") for i in range(100)]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?, ?)", rows)
    db.execute(f"copy documents to '{d}/documents.parquet' (format parquet)")
    return str(d), db


def same(spark, docs, name):
    sf, db = docs
    got = catalogue.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    assert norm(tuple(r) for r in got.select(*cols).collect()) == norm(db.sql(catalogue.ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall())


def test_formatted_tokens(spark, docs):
    same(spark, docs, "formatted_tokens")


def test_places_of_empty_parts(spark):
    """Asked for, an empty part keeps its place; a blank one goes, and so do both unless asked for."""
    shown = lambda *x, **k: spark.range(1).select(text.render_record({n: F.lit(v) for n, v in zip(("text", "title", "other"), x)}, **k)).first()[0]
    assert [shown("", "b"), shown(" ", "b"), shown("", " ", "c")] == ["b", "b", "c"]
    assert [shown("", "b", empty=True), shown(" ", "b", empty=True), shown("", "", empty=True)] == ["\n\nb", "b", None]
    assert [r.t for r in spark.createDataFrame([(x,) for x in ("", " \n", " a", None)], "t string").select(text.unblank(F.col("t")).alias("t")).collect()] == ["", "", " a", None]


def turns(spark, mapper, *said, name="messages", fields=("role", "content"), **k):
    """(role, content) of what a mapper makes of (role, content) pairs, without the system message."""
    ddl = f"system string, tools string, {name} array<struct<`{fields[0]}`:string,`{fields[1]}`:string>>"
    return [tuple(m) for m in mapper(spark.createDataFrame([("", "", list(said))], ddl), **k).first().messages[1:]]


def test_map_conversations(spark, docs):
    same(spark, docs, "map_conversations")
    said = [("human", ""), ("gpt", " \n"), ("gpt", " a ")]
    shown = lambda **k: turns(spark, chat.from_conversations, *said, name="conversations", fields=("from", "value"), **k)
    assert shown() == [("assistant", "a")] and shown(empty=True) == [("user", ""), ("assistant", "a")]


def test_map_function_calls(spark, docs):
    same(spark, docs, "map_function_calls")
    said = [("human", ""), ("gpt", " \n"), ("observation", " a ")]
    shown = lambda **k: turns(spark, chat.from_function_calls, *said, name="conversations", fields=("from", "value"), **k)
    answer = ("user", "<tool_response>\na\n</tool_response>")
    assert shown() == [answer] and shown(empty=True) == [("user", ""), answer]


def test_map_messages(spark, docs):
    """The query's own blank turn goes, that of a blank text stays."""
    same(spark, docs, "map_messages")
    said = [("system", "s"), ("user", "  "), ("user", ""), ("assistant", "\ta")]
    assert turns(spark, chat.from_messages, *said) == [("assistant", "a")]
    assert turns(spark, chat.from_messages, *said, empty=True) == [("user", ""), ("assistant", "a")]


def test_map_reasoning(spark, docs):
    same(spark, docs, "map_reasoning")
    said = [("user", ""), ("assistant", " \n答え： 5 "), ("assistant", "why\n#### 6"), ("assistant", "answer: 7\n")]
    rest = [("assistant", "<think>\nwhy\n</think>\n\n6"), ("assistant", "answer: 7")]
    assert turns(spark, chat.from_reasoning, *said) == [("assistant", "答え： 5"), *rest]
    assert turns(spark, chat.from_reasoning, *said, empty=True) == [("user", ""), ("assistant", "<think>\n\n</think>\n\n5"), *rest]


def test_map_tool_turns(spark, docs):
    same(spark, docs, "map_tool_turns")
    said = [("user", ""), ("assistant", " \n"), ("tool", " a ")]
    shown = lambda **k: turns(spark, chat.from_tool_turns, *said, name="conversations", fields=("from", "value"), **k)
    answer = ("user", "<tool_response>\na\n</tool_response>")
    assert shown() == [answer] and shown(empty=True) == [("user", ""), answer]


def test_mixed_record_lines(spark, docs):
    same(spark, docs, "mixed_record_lines")


def test_places_of_empty_strings(spark):
    """In records of any shape; null, empty lists and mere white space say nothing still."""
    lines = {
        '{"content": "", "ignored": 1}': ("1", ""),
        '{"content": ["", "a", " ", null, [], [" "]], "title": ["\\n"]}': ("a", "\na"),
        '{"content": [{"role": "user", "content": ""}, {"role": "user", "content": " "}, {"role": "user"}, {"content": "b"}]}': ("b", "user: \nb"),
        '{"z": {"text": ""}, "y": {"content": " "}, "a": "c"}': ("c", "\n\nc"),
        '{"text": " ", "title": null}': (None, None),
    }
    df = spark.createDataFrame([(x,) for x in lines], "j string")
    got = df.select("j", records.record_text(F.col("j")).alias("a"), records.record_text(F.col("j"), empty=True).alias("b")).collect()
    assert {r.j: (r.a, r.b) for r in got} == lines
