import random
import zlib

import pytest

import quern.llm.language_id as L
import quern.llm.quality as Q

WORDS = {"en": "the of and thing over water they stone", "fr": "le la et être dans pour où été", "de": "der die und über nicht straße ein schön"}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = []
    for i in range(600):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang].split()) for _ in range(r.randint(20, 120))]
        good = r.random() < 0.7
        text = ". ".join(" ".join(words[k : k + 7]).capitalize() for k in range(0, len(words), 7)) + "." if good else " | ".join(w + r.choice(["###", "%%", ""]) for w in words)
        out.append((i, text, lang, good))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", -1) for d, t, g, _ in rows], "doc_id long, text string, lang string, source string, score int").repartition(3)


ODD = [(None, "the thing and the water", None, True), (9000, None, "en", True), (9001, "", None, True), (9002, "123 !?", "en", True), (9002, "123 !?", "en", True), (9003, "ok " * 60_000, None, True)]


def test_languages(spark, rows):
    got = L.predictions(frame(spark, rows + ODD)).collect()
    assert len(got) == len(rows) + len(ODD)
    want = {d: g for d, _, g, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and not by[d].accepted for d in (9000, 9001, 9002)) and by[None].lang_pred == "en"


def test_languages_without_rows(spark, rows):
    assert L.predictions(frame(spark, rows).limit(0)).collect() == []
    alone = L.predictions(frame(spark, [(1, "text", None, True)])).collect()
    assert alone[0].lang_pred == "und"


def test_every_language_is_learned(spark):
    texts = [(i, f"wort{i % 130} " * 5, f"l{i % 130}", True) for i in range(650)]
    assert set(L.learn(frame(spark, texts))) == {f"l{i}" for i in range(130)}


def test_long_clean_texts_are_kept(spark):
    r = random.Random(4)
    text = {}
    for lang in WORDS:
        words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3_000)]
        text[lang] = lambda n, words=words: " ".join(r.choice(words) for _ in range(n))
    short = [(i, text[lang](100), lang, True) for lang in WORDS for i in range(100)]
    long = [(10_000 + i, text[lang](700_000), lang, True) for i, lang in enumerate(WORDS)]
    assert min(len(t) for _, t, _, _ in long) > 3_000_000
    assert L.keep_known(frame(spark, short + long)).where("doc_id >= 10000").count() == len(long)
    got = L.predictions(frame(spark, short + long)).where("doc_id >= 10000").collect()
    assert all(r.accepted and r.lang_pred == long[r.doc_id - 10_000][2] for r in got)


def test_numerals_are_no_letters(spark, rows):
    odd = [(9000 + i, t, None, True) for i, t in enumerate(["½ ²", "Ⅷ ①", "٣ 4 _", "۩"])] + [(9100, "½ the water", None, True)]
    got = {r.doc_id: r.lang_pred for r in L.predictions(frame(spark, rows + odd)).collect()}
    assert [got[9000 + i] for i in range(4)] == ["und"] * 4 and got[9100] == "en"


def test_languages_as_plain_compression(spark, rows):
    """Each prediction again: the text in pieces, each with the same blanks, by each language's dictionary."""
    import zstandard

    texts = [t for _, t, _, _ in rows[:60]] + ["la", "und", "x y", "straße " * 30_000]
    content = L.learn(frame(spark, rows))
    got = L.identify(frame(spark, [(i, t, None, True) for i, t in enumerate(texts)]), content).select("doc_id", "_lang.lang_pred").collect()
    for r in got:
        raw, sizes = texts[r.doc_id].lower().encode(), {}
        for lang, data in content.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=L.LEVEL)
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[i : i + 65_536] + b" " * 256)) for i in range(0, len(raw), 65_536))
        assert r.lang_pred == min(sorted(sizes), key=sizes.get)


def test_rows_without_ids_do_not_crowd_the_sample(spark, rows):
    flood = [(None, "the of and " * 3, "en", True)] * 3000
    content = L.learn(frame(spark, rows + flood))
    assert set(content) == set(WORDS) and content["en"].count(b"the of and the of and the of and") <= 2 and len(content["en"]) > 5_000


def test_samples_are_never_empty():
    from quern.llm.common import PLACES, below

    assert all(below(20_000, n) >= 1 for n in (0, 1, 10**10, 10**12)) and below(10, 5) == PLACES


def test_quality_as_plain_scores(spark, rows):
    """Scores in Spark are the model's on each whole text; learning is repeatable and takes one text of each doc_id."""
    labels = spark.createDataFrame([(d, int(g)) for d, _, _, g in rows] + [(2, 1 - int(rows[2][3])), (3, int(rows[3][3]))], "doc_id long, quality int")
    docs = frame(spark, rows + [(5, "zzz", "en", True)] * 2000)
    model = Q.learn(docs, labels)
    again = Q.learn(frame(spark, [*rows, (5, "zzz", "en", True)]).repartition(7), labels)
    assert abs(model.weights - again.weights).max() < 1e-9
    texts = [t for _, t, _, _ in rows[:40]] + ["", "a", "b " * 100_000]
    import numpy as np

    want = model.score(np.stack([Q.describe(t) for t in texts]))
    got = {r.doc_id: r._quality for r in Q.scored(frame(spark, [(i, t, None, True) for i, t in enumerate(texts)]), model).collect()}
    assert all(abs(got[i] - w) < 1e-12 for i, w in enumerate(want))
    good, bad = ([s for s, (_, _, _, g) in zip(want, rows[:40], strict=False) if g is x] for x in (True, False))
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_quality(spark, rows):
    docs = frame(spark, rows + ODD)
    labels = spark.createDataFrame([(d, int(g), 0) for d, _, _, g in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.predictions(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {d: g for d, _, _, g in rows}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(bool(r.predicted) == want[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_weights_are_those_of_a_logistic_fit():
    """The loss on differences, written out anew: its gradient is zero at the weights, and a plain descent comes to them."""
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(200, Q.WIDTH)) * r.uniform(0.1, 5, Q.WIDTH)
    good = x[:, 0] / x[:, 0].std() + 0.5 * r.normal(size=200) > 0.4
    model = Q.fit(x, good, pairs=1500)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -6, 6)
    e = np.concatenate([z, z**2 / 6, np.minimum(abs(z), 1), (abs(x) > 1e-9) * 1.0], axis=1)
    draw = np.random.default_rng(0)
    d = e[draw.choice(np.flatnonzero(good), 1500)] - e[draw.choice(np.flatnonzero(~good), 1500)]
    slope = lambda w: Q.DECAY * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + Q.DECAY * w @ w / 2
    assert abs(slope(model.weights)).max() < 1e-7
    w = np.zeros(d.shape[1])
    for _ in range(3000):
        w -= slope(w) / (np.linalg.norm(d, 2) ** 2 / 4 / len(d) + Q.DECAY)
    assert loss(model.weights) <= loss(w) < loss(model.weights) + 1e-3 and np.corrcoef(d @ w, d @ model.weights)[0, 1] > 0.99
    raw = e @ model.weights
    assert abs((raw < model.threshold).mean() - (~good).mean()) <= 1 / 200
    same = model.score(np.stack([x[3], x[3], x[4]]))
    assert same[0] == same[1] != same[2]


def test_quality_without_labels(spark, rows):
    docs, labels = frame(spark, rows[:3]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.predictions(docs, labels).collect()] == [0.5] * 3
    assert Q.predictions(docs.limit(0), labels).collect() == []
