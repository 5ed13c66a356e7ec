"""JSON records of mixed types against the plain rules, and bad ones apart."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import records
from quern.functions.text import TEXT_KEYS
from quern.operators import chat, quarantine


def plain_value(x, depth=99):
    """The rules, on Python values."""
    if isinstance(x, dict):
        if isinstance(x.get("messages"), list):
            said = plain_turns(x["messages"])
            if said:
                return said
        for k in ("content", "text"):
            if k in x:
                return plain_value(x[k])
        return json.dumps(x, ensure_ascii=False, sort_keys=True)
    if isinstance(x, list):
        if x and all(isinstance(i, dict) for i in x):
            return plain_turns(x)
        return "\n".join(t for t in (plain_value(i).strip() for i in x) if t)
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def plain_turns(messages):
    out = []
    for m in messages:
        if isinstance(m, dict):
            text, role = plain_value(m.get("content")).strip(), m.get("role")
            if text:
                out.append(f"{role}: {text}" if role else text)
    return "\n".join(out)


def plain_record(x):
    parts = [plain_value(x[k]).strip() for k in TEXT_KEYS if k in x]
    if not any(parts):
        parts = [plain_value(v).strip() for k, v in x.items() if not k.startswith("_")]
    return "\n\n".join(dict.fromkeys(p for p in parts if p)) or None


GIVEN = [
    {"instruction": "Explain Japanese grammar.", "output": "This is the answer.", "ignored": 123},
    {"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}]},
    {"text": "  a  ", "content": [" x ", "", None, ["deep", ["er"]], 3, 1.5, True], "title": "a"},
    {"content": [{"role": "user", "content": "q"}, {"content": "no role"}, {"role": "user", "content": " "}, {"role": "tool", "content": ["l1", "l2"]}]},
    {"content": {"b": 1, "a": "x, y: \"z\" \\ \n 日", "l": [1, {"k": None}]}},
    {"content": {"messages": [{"role": "user", "content": "in a mapping"}], "content": "not this"}},
    {"content": {"messages": [{"role": "user", "content": ""}], "content": "this instead"}},
    {"content": {"messages": "no list", "text": "told"}},
    {"content": {"messages": [3, {"role": "a", "content": "mixed"}]}},
    {"content": [{"a": 1}, 2, {"text": "t"}]},
    {"content": {}, "output": [], "answer": [{}], "title": None},
    {"_hidden": "x"},
    {"z": "last first", "a": 2, "_no": 1, "m": {"text": "t"}, "dup": "last first"},
    {"text": "", "z": "public instead"},
    {},
    {"text": 0.1, "content": 1e-05, "completion": 12345678.0, "response": 1e22, "output": 100, "answer": 3.0, "prompt": 12345678901234567890123, "instruction": -0.5, "question": False},
    {"text": "　full width　", "content": "\u001cfile\u001f"},
    {"input": [[[["four"]]]]},
    {"context": ["é" * 3000 + " \"quoted\" " * 700, {"k": "v \\" * 2000}, 1]},
]


def anything(r, depth):
    kinds = ["text", "number", "null", "bool"] + (["list", "turns", "mapping"] * 2 if depth else [])
    kind = r.choice(kinds)
    if kind == "list":
        return [anything(r, depth - 1) for _ in range(r.randint(0, 3))]
    if kind == "turns":
        return [{k: v for k, v in (("role", r.choice(["user", "", None])), ("content", anything(r, depth - 1))) if r.random() < 0.9} for _ in range(r.randint(0, 3))]
    if kind == "mapping":
        return {r.choice(["content", "text", "messages", "k", "é"]): anything(r, depth - 1) for _ in range(r.randint(0, 3))}
    return {"text": r.choice(["a", " b ", "", "c:d", "日\n本", '"q"']), "number": r.choice([0, -7, 2.5, 10**12]), "null": None, "bool": r.random() < 0.5}[kind]


def test_as_the_plain_rules(spark):
    r = random.Random(2)
    rows = GIVEN + [{k: anything(r, 2) for k in r.sample(["text", "content", "output", "title", "x", "_y", "messages"], r.randint(1, 4))} for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=i % 2 == 0)) for i, x in enumerate(rows)], "i int, j string").repartition(3)
    got = {x.i: x.t for x in df.select("i", records.record_text(F.col("j")).alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [plain_record(x) for x in rows]


def test_deeper_levels_are_json(spark):
    deep = json.dumps({"text": [[[[["five", {"b": 1, "a": 2}]]]]]})
    df = spark.createDataFrame([(deep,)], "j string")
    assert df.select(records.record_text(F.col("j"), 2)).first()[0] == '[[["five", {"a": 2, "b": 1}]]]'


def test_faults_and_quarantine(spark, tmp_path):
    lines = ['{"text": "a"}', "", None, "  ", "{broken", "[1]", '"s"', '{"a": 1, "a": 2}', "null", '{"b": 2}', '{"text": "a"}']
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, n int").repartition(2)
    good, bad = quarantine.separated(df, records.fault(F.col("line")), str(tmp_path / "q"))
    assert sorted(x.n for x in good.collect()) == [0, 9, 10] and good.columns == df.columns
    assert {x.n: x.reason for x in bad.collect()} == {1: "blank", 2: "blank", 3: "blank", 4: "no JSON, or repeated keys", 5: "no mapping", 6: "no mapping", 7: "no JSON, or repeated keys", 8: "no mapping"}
    assert good.count() + bad.count() == df.count()


def test_unknown_roles_go_to_quarantine(spark, tmp_path):
    rows = [(1, [("user", "a"), (" Assistant ", "b")]), (2, [("user", "a"), ("tool", "b"), ("judge", "c")]), (3, []), (4, None), (5, [(None, "x")]), (2, [("user", "a"), ("tool", "b"), ("judge", "c")])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="unsupported role"):
        df.select(chat.normalise(F.col("messages"))).collect()
    good, bad = quarantine.separated(df, quarantine.role_fault(F.col("messages")), str(tmp_path / "q"))
    assert [x.m for x in good.select(F.size(chat.normalise(F.col("messages"))).alias("m")).collect()] == [2]
    assert sorted((x.id, x.reason) for x in bad.collect()) == [(2, "unknown role: tool"), (2, "unknown role: tool"), (3, "no messages"), (4, "no messages"), (5, "unknown role: ")]
