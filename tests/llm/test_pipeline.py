"""Each pipeline stage against a plain version, on small tables with clashing and extra columns."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import quern.llm.language_id as L
import quern.llm.packing as K
import quern.llm.quality as Q
from tests.llm.test_classifiers import WORDS
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    f = str(tmp_path_factory.mktemp("sf"))
    # Three-word tokens keep the vocabulary large enough that unrelated texts share few shingles.
    word = lambda g: "".join(r.choice(WORDS[g].split()) for _ in range(3))
    text = lambda g, n: " ".join(word(g) for _ in range(n))
    rows, labels = [], []
    passage = text("en", 60)
    for i in range(240):
        g, good = r.choice(list(WORDS)), r.random() < 0.75
        t = text(g, r.randint(15, 80))
        t = t.capitalize() + "." if good else " | ".join(w + r.choice(["###", "%%"]) for w in t.split())
        rows.append((i, t, g, f"s{i % 4}", len(t)))
        labels.append((i, int(good), 0))
    clean = [x for x in rows if x[1].endswith(".")]
    for k, (_, t, g, s, n) in enumerate(clean[:25]):
        w = t.split()
        if k % 3 == 0:
            w[len(w) // 2] = "changed"
        rows.append((1000 + k, " ".join(w), g, s, n))
    rows += [(2000 + k, (text("en", 25) + " " + passage + " " + text("en", 25)).capitalize() + ".", "en", "s1", 0) for k in range(6)]
    rows += [(3000, None, "en", None, None), (3001, "", None, "s1", 0), (3002, "123 456.", "en", "s1", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{f}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{f}/labels.parquet")
    return f


def test_stages_as_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "language_id", "near_duplicates", "suffix_dedup", "best_fit_packing"]
    columns = docs.dtypes
    state = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        state[name] = (before, {r.doc_id: r for r in out.collect()} if n < 4 else out.collect())
        if n < 4:
            assert out.dtypes == columns
        docs = out

    before, after = state["quality_classifier"]
    full, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = Q.learn(full, labels.where(~L.held_out("doc_id", 3, 1)))
    want = {d for d, r in before.items() if model.score(Q.describe(r.text)[None])[0] >= 0.5}
    assert set(after) == want
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & set(after)) >= 0.95 * len(good)

    before, after = state["language_id"]
    model = L.Model(L.learn(spark.createDataFrame(list(before.values()), full.schema).where(~L.held_out("doc_id", 5, 0))))
    want = {d for d, r in before.items() if model.predict(r.text)[2]}
    assert set(after) == want and len(after) >= 0.95 * len([r for r in before.values() if r.text and r.doc_id != 3002])

    before, after = state["near_duplicates"]
    groups = near_brute([(d, r.text) for d, r in before.items()], 5, 80)
    assert set(after) == {d for d, _, c in groups if d == c}
    assert len(after) < len(before)

    before, after = state["suffix_dedup"]
    removed = {d: n for d, _, n, _, _ in suffix_brute([(d, r.text) for d, r in before.items()])}
    assert set(after) == set(before) and any(removed.values())
    assert all(len((before[d].text or "").encode()) - removed[d] == len((after[d].text or "").encode()) for d in after)

    before, pieces = state["best_fit_packing"]
    tok = Tokenizer.from_file(corpus_pipeline.JSON)
    want = Counter()
    for d, r in before.items():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        for k, (s, m) in enumerate(K.cut(n, 2048)):
            want[d, k, s, m] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length) for p in pieces) == want
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(np.cumsum([0, *[n for _, n in sorted(v)]])[:-1].tolist() == [o for o, _ in sorted(v)] and sum(n for _, n in v) <= 2048 for v in by.values())


def test_whole_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
