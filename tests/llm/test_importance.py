import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pandas as pd
import pytest

import quern.llm.importance as I

DDL = "doc_id long, text string, score double, weight string"


def plain(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    """Word by word from the definition."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]

    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, text in docs:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n=150):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "ÉCOLE", "日本", "A1", "x_y", "don't", "ß"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "!!! ..."), (903, "one"), (904, "Same\twords\nSAME words " * 30), (None, rows[0][1] + " " + rows[3][1] * 3), (904, "Same\twords\nSAME words " * 30), (905, "a" * 300 + " " + "b1 " * 50)]
    target = [" ".join(r.choice(vocabulary[:8]) for _ in range(40)) for _ in range(12)] + [None, ""]
    return rows, target


def run(spark, rows, target, **k):
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t in rows], DDL).repartition(3)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    return sorted((tuple(x) for x in I.scores(docs, bench, **k).collect()), key=repr)


def test_as_plain_and_as_sql(spark):
    rows, target = corpus()
    want = plain(rows, target)
    assert run(spark, rows, target) == want
    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]}))
    db.register("benchmark", pd.DataFrame({"text": target}))
    assert sorted(db.execute(I.oracle()).fetchall(), key=repr) == want


def test_small_tries_and_blocks_change_nothing(spark, monkeypatch):
    rows, target = corpus(60)
    rows += [(800 + i, "shared words of the target " * 5) for i in range(70)]  # ties in weight
    long = " ".join(random.Random(1).choice(["w1", "w2", "ä", "Z9"]) for _ in range(9000))
    rows.append((5000, long))
    want = plain(rows, target, percent=40, least=3)
    for name, value in (("NODES", 7), ("BLOCK", 100), ("WORDS", 37)):
        monkeypatch.setattr(I, name, value)
    assert [w for block in I.blocks(long.encode()) for w in block] == [w.lower() for w in long.encode().split()]
    assert run(spark, rows, target, percent=40, least=3) == want


def test_texts_go_on_over_batches(monkeypatch):
    """In one process: every way to cut gives the counts and sums of the whole."""
    rows, _ = corpus(40)
    texts = [(i, None if t is None else t.encode()) for i, (_, t) in enumerate(rows)] + [(99, ("x" * 60 + " y é ") .encode() * 30)]
    gain = I.np.arange(1000) - 400

    def all_of():
        trie, out = I.Trie(), {}
        for words, starts, keys, led in I.batches(iter(texts)):
            for k, n, total in zip(keys, *I._weigh(trie, gain, words, starts, led), strict=True):
                old = out.get(k, (0, 0))
                out[k] = (old[0] + int(n), old[1] + int(total))
        return out

    want = {}
    for k, raw in texts:
        w = [x for block in I.blocks(raw) for x in block]
        features = w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]
        want[k] = (len(w), sum(int(gain[crc32(f) % 1000]) for f in features))
    assert all_of() == want
    for block, words in ((1, 1), (50, 3), (100, 37), (10**6, 200)):
        monkeypatch.setattr(I, "BLOCK", block)
        monkeypatch.setattr(I, "WORDS", words)
        assert all_of() == want


def test_a_text_of_megabytes():
    text = ("Word, " * 700_000 + "x" * 3_000_000).encode()
    trie, n, total = I.Trie(), 0, 0
    for words, starts, _, led in I.batches(iter([(0, text)])):
        a, b = I._weigh(trie, I.np.ones(10, I.np.int64), words, starts, led)
        n, total = n + int(a[0]), total + int(b[0])
        assert len(words) < 2 * I.WORDS
    assert (n, total) == (700_001, 1_400_001) and len(trie.index) == 2
    pair = trie.nodes([b"word", b"x" * 3_000_000])
    assert trie.pair_states(I.np.array([pair[0] << 32 | pair[0], pair[0] << 32 | pair[1]])).tolist() == [crc32(b"word word"), crc32(b"word " + b"x" * 3_000_000)]


@pytest.mark.parametrize("percent", [0, 100])
def test_shares_and_empty_tables(spark, percent):
    rows, target = corpus(30)
    ranks = [r[4] for r in run(spark, rows, target, percent=percent) if r[4] is not None]
    able = sum(sum(map(len, I.blocks((t or "").encode()))) >= 20 for _, t in rows)
    assert sorted(ranks) == list(range(1, able + 1) if percent else [])
    assert run(spark, [], target) == []
    assert run(spark, rows, []) == plain(rows, [])


def test_drawn_rows_keep_their_columns(spark):
    rows, target = corpus(60)
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t in rows], DDL)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.drawn(docs, bench)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r[0] for r in plain(rows, target) if r[4]}
