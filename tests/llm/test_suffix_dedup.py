import hashlib
import random
from collections import Counter

import quern.llm.suffix_dedup as S


def brute(rows):
    """Removes by counting every string of WIDTH bytes."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + S.WIDTH] for _, t in texts for i in range(len(t) - S.WIDTH + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - S.WIDTH + 1):
            if count[t[i : i + S.WIDTH]] > 1:
                gone[i : i + S.WIDTH] = b"\1" * S.WIDTH
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(150), text(60)
    rows = [(i, text(r.randint(5, 120))) for i in range(12)]
    rows += [(20, base), (21, base), (22, base[:400] + "X" + base[401:]), (22, base[:330])]
    rows += [(30 + i, text(20) + passage + text(20)) for i in range(5)] + [(40, passage[:199]), (41, passage[:200]), (42, passage[1:205])]
    rows += [(50, "ab" * 900), (51, "x" * 200), (52, "y" * 201), (53, ""), (54, None), (None, base[100:500]), (None, base[100:500]), (60, "abc" * 300 + text(30))]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_as_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, piece string").repartition(3)
    assert got(S.digest(df)) == brute(rows)


def test_segments_of_long_texts(spark, monkeypatch):
    rows = [(d, t * 7 if t and d and d < 12 else t) for d, t in fixture()]
    data = [t.encode() for _, t in rows if t]
    keep = S.SEGMENT
    try:
        S.SEGMENT = 700
        parts = list(S._documents(iter([_batch(rows)])))
        assert max(len(x) for _, x in parts) <= 700 + S.WIDTH - 1 and len(parts) > len(data)
    finally:
        S.SEGMENT = keep


def _batch(rows):
    import pyarrow as pa

    return pa.record_batch([pa.array([d or 0 for d, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([(t or "").encode() for _, t in rows], pa.binary())], names=["id", "th", "text"])


def test_empty_table(spark):
    assert got(S.digest(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_remove_repeats_keeps_columns(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, "fr", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = S.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_repeats_over_a_segment_border(spark):
    """Passages across the border of two segments of one long text, and long text that repeats itself, as brute force."""
    r = random.Random(9)
    letters = "".join(r.choices("abcdefghij ", k=S.SEGMENT + 60_000))
    at = S.SEGMENT - 150
    long = letters[: S.SEGMENT + 40_000]
    rows = [(1, long), (2, "q" + letters[at : at + 300] + "z"), (3, letters[S.SEGMENT - 199 : S.SEGMENT + 1]), (4, letters[S.SEGMENT - 198 : S.SEGMENT + 1]), (5, long[100:700] + "w" + long[100:500]), (6, "abcd" * 3_000 + letters[-300:] * 2)]
    count = Counter(hash(t[i : i + S.WIDTH]) for _, t in rows for i in range(len(t) - S.WIDTH + 1))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - S.WIDTH + 1):
            if count[hash(t[i : i + S.WIDTH])] > 1:
                gone[i : i + S.WIDTH] = b"\1" * S.WIDTH
        kept = bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert want[0][2] > 0 and want[3][2] == 0
    assert got(S.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(want, key=str)
