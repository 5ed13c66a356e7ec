"""Quality by Bradley-Terry pairwise ranking.

Each text has a fixed-length description (counts over its bytes, words and lines). From preference pairs (a text
labelled good over one labelled bad) weights are learned by the logistic loss on the difference of the two
descriptions. A text's score is its weighted description; the threshold is the quantile of the training scores at
the share of bad labels, and scores map to 0..1 around it.

Training takes at most about ``LABELLED`` labelled texts, by a hash of their doc_id, and ``PAIRS`` pairs; both
bounds hold at any corpus size. Scoring reads every text whole.

Defined cases: null text is empty; an empty text has a score; rows with null labels teach nothing; several labels
of one doc_id count by their mean (0.5 and above is good), of its texts the least one teaches; without both kinds of label every score is 0.5; repeated rows and null
doc_ids are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACES, below
from .language_id import held_out

LABELLED, PAIRS, ROUNDS, DECAY = 20_000, 100_000, 25, 1e-3
# Byte classes, as fixed values.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",", b"|", b"#$%&*+/<=>@\\^_`{}~", b"!?;:", b"'\"()[]-", b"\t\0")
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c), _i] = 1
_TABLE[128:, -1] = 1
WIDTH = len(_CLASSES) + 1 + 11


def describe(text: str | None) -> np.ndarray:
    """The description of one text; all-finite for any input."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    words = raw.split()
    m = len(words)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / max(1, n)
    if not m:
        return np.concatenate([shares, np.zeros(11)])
    counts = Counter(words)
    lines = raw.split(b"\n")
    ends = sum(w.endswith((b".", b",")) for w in words)
    more = [np.log1p(n), np.log1p(m), (n - m) / m, len(counts) / m, max(counts.values()) / m, sum(map(eq, words, words[1:])) / m, len(set(lines)) / len(lines), np.log1p(n / len(lines)), ends / m, sum(len(w) == 1 for w in words) / m, np.log(len(counts)) / max(1.0, np.log(m))]
    return np.concatenate([shares, more])


class Model:
    """Description -> score: standardised values, their squares and caps, weighted."""

    def __init__(self, mean, scale, weights, threshold: float, slope: float):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6, np.minimum(np.abs(z), 1.0), (np.abs(x) > 1e-9) * 1.0], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.slope, -50, 50)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> Model:
    """Bradley-Terry weights from pairs (good, bad), by Newton steps on the logistic loss of differences."""
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(4 * WIDTH), 0.0, 1.0)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    e = model.expand(x)
    r = np.random.default_rng(0)
    d = e[r.choice(up, pairs)] - e[r.choice(down, pairs)]
    w = np.zeros(e.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance given to the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + DECAY * np.eye(len(w)), d.T @ p / len(d) - DECAY * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    raw = e @ w
    model.threshold = float(np.quantile(raw, (~good).mean()))
    model.slope = float(1 / (raw.std() + 1e-9)) * 3
    return model


def describe_all(texts: pd.Series) -> np.ndarray:
    return np.stack([describe(t) for t in texts]) if len(texts) else np.zeros((0, WIDTH))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): a model from at most about LABELLED of them."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    total = marks.count()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(6)), F.lit(PLACES)) < below(LABELLED, total)

    @F.pandas_udf("array<double>")
    def description(texts: pd.Series) -> pd.Series:
        return pd.Series(list(describe_all(texts)), dtype=object)

    # Only texts in the sample leave their scan, one (the least) of each doc_id.
    texts = docs.where(place).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.join(marks.where(place), "doc_id").select("doc_id", "q", description("text").alias("x"))
    rows = rows.orderBy("doc_id").limit(2 * LABELLED).collect()
    if not rows:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, bool))
    return fit(np.array([r.x for r in rows]), np.array([r.q >= 0.5 for r in rows]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Adds _quality, the score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(describe_all(texts)))

    return docs.withColumn("_quality", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels that are not held out."""
    model = learn(docs, labels.where(~held_out("doc_id", 3, 1)))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a score of 0.5 or more."""
    model = learn(docs, labels.where(~held_out("doc_id", 3, 1)))
    return scored(docs, model).where("_quality >= 0.5").select(*docs.columns)
