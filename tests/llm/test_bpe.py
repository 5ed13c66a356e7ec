import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import quern.llm.bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


def rows():
    r = random.Random(1)
    odd = ["", " ", "  ", "\n", " \n", "\t x", "a  b", "it's we'LL", "x y", "  z", "日本 語", "é à", "12 3a", "!?", "\x1c", "\x1c q", "🙂", "end ", " a\n\n b", "<|endoftext|>"]
    out = [(i, "".join(r.choice(odd) + r.choice(["", " ", "word"]) for _ in range(r.randint(0, 30)))) for i in range(120)]
    return [*out, (500, None), (500, "again"), (None, "no id"), (501, "long " * 5000)]


def test_as_tiktoken(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 900)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(open(PATH, "rb").read()), special_tokens={})
    want = []
    for d, t in rows():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    df = spark.createDataFrame([(d, t, "b") for d, t in rows()], "doc_id long, text string, block string").repartition(3)
    got = [tuple(x) for x in B.digest(df, PATH, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(1, "Hello, wörld 42"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: bytes(r.data) for r in B.decode(B.encode(df, PATH, P.PATTERN), PATH).collect()}
    assert back == {1: "Hello, wörld 42".encode(), 2: b""}
    assert B.digest(df.limit(0), PATH, P.PATTERN).collect() == []


def test_decoding_is_a_join(spark):
    vocabulary = B.read_ranks(open(PATH, "rb").read())
    token = {i: t for t, i in vocabulary.items()}
    r = random.Random(3)
    rows = [(i % 40, [r.choice(list(token)) for _ in range(r.randint(0, 200))]) for i in range(90)] + [(None, [5, 5]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(4)
    got = sorted(((x.doc_id, None if x.data is None else bytes(x.data)) for x in B.decode(df, PATH).collect()), key=str)
    assert got == sorted(((d, None if x is None else b"".join(token[i] for i in x)) for d, x in rows), key=str)
    assert "BroadcastHashJoin" in B._with_token_bytes(spark.createDataFrame([("b", 0, [1])], "block string, bucket int, used array<int>"), open(PATH, "rb").read())._jdf.queryExecution().executedPlan().toString()
    assert B.decode(df.limit(0), PATH).collect() == []
    for bad in (10**6, -1):
        with pytest.raises(Exception, match="vocabulary"):
            B.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), PATH).collect()


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    B.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
