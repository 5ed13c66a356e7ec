import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import quern.llm.packing as K

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def rows():
    r = random.Random(5)
    words = ["the", "of", "thand", "Ère", "12", "x\n", "\n\ny", "日本", "<|endoftext|>", "it's", " ", "", "🙂!"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 200)))) for i in range(150)]
    return [*out, (900, None), (901, ""), (150, "again"), (150, "again"), (None, "no id"), (902, "tall " * 900)]


@pytest.mark.parametrize("length", [64, 256])
def test_pieces_and_places(spark, length):
    df = spark.createDataFrame([(d, t, "z") for d, t in rows()], "doc_id long, text string, part string").repartition(3)
    got = K.pack(df, *FILES, length).collect()
    tok = Tokenizer.from_file(FILES[0])
    want = Counter()
    for d, t in rows():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        first = n if n <= length else (n % length or length)
        cuts = [0, *range(first, n, length)] if n > length else [0]
        for k, s in enumerate(cuts):
            piece = ids[s : cuts[k + 1] if k + 1 < len(cuts) else n]
            want[d, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= length
    assert len(by) <= 1.05 * sum(r.length for r in got) / length + 2


def test_plan_packs_the_histogram_whole():
    r = np.random.default_rng(0)
    for h in ({}, {2048: 5}, {1: 10_000}, {1500: 7, 548: 6}, dict(zip(*(x.tolist() for x in np.unique(np.minimum(2048, r.gamma(2, 500, 20_000).astype(int) + 1), return_counts=True)), strict=True))):
        packed = K.plan(h)
        used = Counter()
        for pattern, times in packed:
            assert sum(n * m for n, m in pattern) <= 2048
            for n, m in pattern:
                used[n] += m * times
        assert used == Counter(h)
        total = sum(n * c for n, c in h.items())
        assert sum(t for _, t in packed) <= max(1.002 * total / 2048 + 2, 7)


def test_empty(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []
