"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from texts known to be in it. A text is compressed whole,
in lower case, with each dictionary; the one that makes it smallest names its language. ``accepted`` is false where the
second-best is nearly as small. A text of any length is compressed in pieces of PIECE bytes, whose sizes are summed: within
one piece a dictionary soon has no more to add to what the text itself has said, so the gap would shrink against the
size of a long text. Each piece is followed by the same blanks, which cost next to nothing: of a lone short
piece the compressor would store every byte, whatever the dictionary.

Training reads at most ``TEXTS`` texts a language, taken by a hash of their doc_id and text, and at most ``SLICE``
characters from the middle of each; a dictionary holds at most ``DICTIONARY`` bytes. These bounds hold at any
corpus size. Every language that occurs is learned, so the driver's memory and the time a text takes grow with their number.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and not accepted; with nothing to
learn from, all is ``und``; ties between dictionaries go to the first name; repeated rows and null doc_ids are
predicted each; rows with null lang or text teach nothing; further columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACES, below

TEXTS, SLICE, DICTIONARY, LEVEL, PIECE = 400, 400, 24_000, 6, 65_536
_BLANKS = b" " * 256
#: Accepted where the second-best output is larger than the best by this share of it at least.
MARGIN = 0.002


def learn(docs: DataFrame) -> dict[str, bytes]:
    """docs(doc_id, text, lang) -> dictionary content by language. Bounded rows reach the driver."""
    known = docs.where("lang is not null and text is not null")
    totals = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not totals:
        return {}
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES))
    shares = docs.sparkSession.createDataFrame([(r.lang, below(2 * TEXTS, r.n)) for r in totals], "lang string, below long")
    middle = F.substring("text", F.greatest(F.lit(1), F.expr(f"int((length(text) - {SLICE}) / 2)")), F.lit(SLICE))
    few = known.join(F.broadcast(shares), "lang").where(place < F.col("below")).select("lang", place.alias("place"), middle.alias("text")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    rows = few.withColumn("r", first).where(F.col("r") <= TEXTS).orderBy("place", "text").collect()
    out: dict[str, bytes] = {}
    taken: dict[str, int] = {}
    for r in rows:
        if taken.get(r.lang, 0) < TEXTS and len(out.get(r.lang, b"")) < DICTIONARY:
            taken[r.lang] = taken.get(r.lang, 0) + 1
            out[r.lang] = out.get(r.lang, b"") + r.text.lower().encode("utf-8", "replace") + b"\n"
    return {k: v[:DICTIONARY] for k, v in sorted(out.items())}


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = []
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.by or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[at : at + PIECE] + _BLANKS for at in range(0, len(raw), PIECE)]
        sizes = sorted((sum(len(c.compress(x)) for x in pieces), i) for i, (_, c) in enumerate(self.by))
        best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else math.inf
        # Odds of the languages, were each output byte that is saved worth half a bit.
        score = 1 / sum(math.exp(min(0.0, (best - n) * math.log(2) / 2)) for n, _ in sizes)
        return self.by[sizes[0][1]][0], score, second - best > MARGIN * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Adds _lang, a struct of lang_pred, score and accepted, to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    models: list[Model] = []

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not models:
            models.append(Model(shared.value))
        return pd.DataFrame([models[0].predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.withColumn("_lang", predict(F.col("text").cast("string")))


def held_out(doc_id: str, of: int, remainder: int):
    """crc32 of the doc_id as text, modulo ``of``, is ``remainder``; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(of)) == remainder, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; learned from the rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", 5, 0).alias("held_out"))
    model = learn(rows.where("not held_out"))
    return identify(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "_lang.lang_pred", "_lang.score", "_lang.accepted")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs whose language is recognised with a clear margin."""
    model = learn(docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 5, 0)))
    return identify(docs, model).where("_lang.accepted").select(*docs.columns)
